"""Column expressions that reproduce R's value semantics with built-in Spark functions.

All helpers return ``Column`` objects, so they stay inside whole-stage codegen;
none of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r_if(cond: Column, yes, no) -> Column:
    """``if_else(cond, yes, no)``: a NULL condition gives NULL (SQL CASE would fall through)."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond, yes).when(~cond, no)


def r_round(x: ColumnOrName, digits: int = 0) -> Column:
    """``round(x, digits)`` as in R >= 4: the nearer of the two decimal neighbours
    (computed in double arithmetic), an exact tie goes to the even last digit.

    Spark's ``round`` (HALF_UP on the decimal text) and ``bround`` both differ,
    e.g. 120.35 -> 120.3 and 931.25 -> 931.2 here.
    """
    x = _c(x).cast("double")
    p = float(10 ** digits)
    ax = F.abs(x)
    scaled = ax * F.lit(p)
    low_i = F.floor(scaled)
    low = low_i / F.lit(p)
    high = F.ceil(scaled) / F.lit(p)
    d_low = ax - low
    d_high = high - ax
    pick = (F.when(d_high < d_low, high)
            .when(d_low < d_high, low)
            .when(low_i % 2 == 1, high)
            .otherwise(low))
    # beyond 15 significant digits nothing is rounded (and floor() would overflow)
    rounded = F.when(scaled >= F.lit(1e15), ax).otherwise(pick)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.signum(x) * rounded)


# ---- the same rules as Spark SQL text -------------------------------------
# Compound rules are generated as SQL text and parsed once by Catalyst
# (``F.expr`` / ``selectExpr``): the resulting expressions are identical to the
# Column-API forms above, but building them costs one call instead of dozens.


def sql_double(x: float) -> str:
    """A DOUBLE literal (a bare ``12.5`` is a DECIMAL in Spark SQL)."""
    return f"{float(x)!r}D"


def r_if_sql(cond: str, yes: str, no: str) -> str:
    return f"(CASE WHEN {cond} THEN {yes} WHEN NOT ({cond}) THEN {no} END)"


def r_round_sql(x: str, digits: int = 0) -> str:
    """SQL text of :func:`r_round`."""
    p = sql_double(10 ** digits)
    v = f"CAST(({x}) AS DOUBLE)"
    ax = f"abs({v})"
    lo_i = f"floor({ax} * {p})"
    lo = f"({lo_i} / {p})"
    hi = f"(ceil({ax} * {p}) / {p})"
    pick = (f"CASE WHEN ({hi} - {ax}) < ({ax} - {lo}) THEN {hi} "
            f"WHEN ({ax} - {lo}) < ({hi} - {ax}) THEN {lo} "
            f"WHEN {lo_i} % 2 = 1 THEN {hi} ELSE {lo} END")
    return (f"(CASE WHEN {v} IS NULL THEN CAST(NULL AS DOUBLE) "
            f"ELSE signum({v}) * (CASE WHEN {ax} * {p} >= 1.0E15D THEN {ax} ELSE {pick} END) END)")


def paste0_sql(*parts: str) -> str:
    return "concat(" + ", ".join(f"coalesce(CAST({p} AS STRING), 'NA')" for p in parts) + ")"


def replace_first_sql(x: str, literal: str, replacement: str = "") -> str:
    pat = "(?s)^(.*?)" + _regex_quote(literal)
    repl = "$1" + replacement.replace("\\", "\\\\").replace("$", "\\$")
    return f"regexp_replace({x}, '{pat}', '{repl}')"


def str_match_sql(x: str, pattern: str) -> str:
    return f"nullif(regexp_extract({x}, '({pattern})', 1), '')"


def r_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """R division for ratios; x/0 (NaN or Inf in R) becomes NULL (ANSI-safe)."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def str_c(*cols: ColumnOrName, sep: str = "") -> Column:
    """``str_c``: any NULL input makes the result NULL (``concat_ws`` would skip it)."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i and sep:
            parts.append(F.lit(sep))
        parts.append(_c(c).cast("string"))
    return F.concat(*parts)


def paste0(*cols: ColumnOrName, sep: str = "") -> Column:
    """``paste0`` / ``unite``: a NULL input is written as the text ``NA``."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i and sep:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(_c(c).cast("string"), F.lit("NA")))
    return F.concat(*parts)


def str_sub(x: ColumnOrName, start: int, end: int) -> Column:
    """``str_sub(x, start, end)``: 1-based, end inclusive."""
    return F.substring(_c(x), start, end - start + 1)


def _regex_quote(text: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != "_" else ch for ch in text)


def replace_first(x: ColumnOrName, literal: str, replacement: str = "") -> Column:
    """``str_replace``: only the first occurrence (Spark's replace functions are global)."""
    repl = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(_c(x), "(?s)^(.*?)" + _regex_quote(literal), "$1" + repl)


def str_match(x: ColumnOrName, pattern: str) -> Column:
    """``str_match(x, pattern)[,1]``: the matched text or NULL."""
    return F.nullif(F.regexp_extract(_c(x), f"({pattern})", 1), F.lit(""))


def html_escape(x: ColumnOrName) -> Column:
    """``htmlEscape`` of text content: & first, then < and >."""
    c = _c(x).cast("string")
    for src, dst in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(src), F.lit(dst))
    return c


def strip_number_text(x: ColumnOrName) -> Column:
    """``as.character(as.numeric(x))``: "01" -> "1", "2.50" -> "2.5", bad text -> NULL."""
    d = _c(x).try_cast("double")
    as_int = d.try_cast("bigint")
    return (F.when(d.isNull(), F.lit(None).cast("string"))
            .when(as_int.isNotNull() & (as_int.cast("double") == d), as_int.cast("string"))
            .otherwise(d.cast("string")))


def null_tokens(df: DataFrame, tokens: Iterable[str], cols: Iterable[str] | None = None) -> DataFrame:
    """Turn every listed NA token into NULL, in one projection (CSV ``nullValue`` takes one token)."""
    tokens = list(tokens)
    target = set(cols) if cols is not None else {
        f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    return df.select(*[
        (F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) if c in target else F.col(f"`{c}`"))
        for c in df.columns])


def fill_zero(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """``replace(., is.na(.), 0)`` over numeric columns."""
    numeric = [f.name for f in df.schema.fields
               if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal")]
    subset = [c for c in (cols if cols is not None else numeric)]
    return df.fillna(0, subset=subset) if subset else df
