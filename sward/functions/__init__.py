from sward.functions.rsem import (  # noqa: F401
    fill_zero,
    html_escape,
    null_tokens,
    paste0,
    r_div,
    r_if,
    r_round,
    replace_first,
    str_c,
    str_match,
    str_sub,
    strip_number_text,
)
