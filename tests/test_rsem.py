import pytest
from pyspark.sql import functions as F

from conftest import rows
from sward.functions import rsem


@pytest.mark.parametrize("x,d,want", [
    (120.35, 1, 120.3), (931.25, 1, 931.2), (283.95, 1, 284.0), (399.75, 1, 399.8),
    (1934.85, 1, 1934.8), (479.05, 1, 479.0), (1723.05, 1, 1723.0),
    (0.125, 2, 0.12), (0.375, 2, 0.38), (2.5, 0, 2.0), (3.5, 0, 4.0), (-2.5, 0, -2.0),
    (-120.35, 1, -120.3), (0.0, 1, 0.0), (12.3456, 3, 12.346),
])
def test_r_round_matches_r(spark, x, d, want):
    df = spark.createDataFrame([(x,)], "x double")
    col_form = rows(df.select(rsem.r_round("x", d)))[0][0]
    sql_form = rows(df.select(F.expr(rsem.r_round_sql("x", d))))[0][0]
    assert col_form == want
    assert sql_form == want


def test_r_round_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert rows(df.select(rsem.r_round("x", 1)))[0][0] is None


def test_r_if_null_condition_is_null(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    got = rows(df.select(rsem.r_if(F.col("x") > 2, "yes", "no")))
    assert got == [("no",), (None,), ("yes",)]
    got_sql = rows(df.select(F.expr(rsem.r_if_sql("x > 2", "'yes'", "'no'"))))
    assert got_sql == got


def test_replace_first_only(spark):
    df = spark.createDataFrame([("NANA",), ("abNAcdNA",), ("none",), (None,)], "s string")
    got = rows(df.select(rsem.replace_first("s", "NA")))
    assert got == [("NA",), ("abcdNA",), ("none",), (None,)]
    got_sql = rows(df.select(F.expr(rsem.replace_first_sql("s", "NA", "non-FFH"))))
    assert got_sql == [("non-FFHNA",), ("abnon-FFHcdNA",), ("none",), (None,)]


def test_str_c_vs_paste0(spark):
    df = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string")
    assert rows(df.select(rsem.str_c("x", "y", sep="_"))) == [(None,), ("a_b",)]
    assert rows(df.select(rsem.paste0("x", "y", sep="_"))) == [("a_NA",), ("a_b",)]


def test_str_sub_and_match(spark):
    df = spark.createDataFrame([("X01_m_2017",), ("G214-GE6510",)], "s string")
    assert rows(df.select(rsem.str_sub("s", 2, 3))) == [("01",), ("21",)]
    assert rows(df.select(rsem.str_match("s", "6510"))) == [(None,), ("6510",)]


def test_html_escape(spark):
    df = spark.createDataFrame([("a & <b>",), (None,)], "s string")
    assert rows(df.select(rsem.html_escape("s"))) == [("a &amp; &lt;b&gt;",), (None,)]


def test_strip_number_text(spark):
    df = spark.createDataFrame([("01",), ("00070",), ("2.50",), ("x1",), (None,)], "s string")
    assert rows(df.select(rsem.strip_number_text("s"))) == [("1",), ("70",), ("2.5",), (None,), (None,)]


def test_null_tokens_and_fill_zero(spark):
    df = spark.createDataFrame([("", "1"), ("NA", "2"), ("na", None), ("text", "3")], "a string, b string")
    cleaned = rsem.null_tokens(df, ["", "NA", "na"])
    assert rows(cleaned, "a") == [(None,), (None,), (None,), ("text",)]
    num = cleaned.select(F.col("b").try_cast("double").alias("b"))
    assert rows(rsem.fill_zero(num)) == [(1.0,), (2.0,), (0.0,), (3.0,)]


def test_r_div_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0)], "a double, b double")
    assert rows(df.select(rsem.r_div("a", "b"))) == [(None,), (0.25,)]


def _r_round_reference(x: float, d: int) -> float:
    """Independent statement of R >= 4 rounding for the property test."""
    import math
    if x < 0:
        return -_r_round_reference(-x, d)
    p = 10.0 ** d
    lo_i = math.floor(x * p)
    lo, hi = lo_i / p, math.ceil(x * p) / p
    if hi - x < x - lo:
        return hi
    if x - lo < hi - x:
        return lo
    return hi if lo_i % 2 == 1 else lo


def test_r_round_property(spark):
    import random
    rnd = random.Random(11)
    xs = ([rnd.uniform(-2000, 2000) for _ in range(300)]
          + [round(rnd.uniform(0, 2000), 2) for _ in range(300)]       # two-decimal values (ties at 1 digit)
          + [k / 8 for k in range(-400, 400)])                          # exact binary ties
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for d in (0, 1, 2, 3):
        got = [r[0] for r in df.select(F.expr(rsem.r_round_sql("x", d))).collect()]
        assert got == [_r_round_reference(x, d) for x in xs]
