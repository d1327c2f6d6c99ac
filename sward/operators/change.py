"""Visits per plot (A24, A25) and the multi-year change class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values of the reference ----
NON_FFH, ANY_FFH = "non-FFH", "any-FFH"
# states of three years (N: no FFH type, F: an FFH type) -> change class; FFF depends on the classes
CHANGE_OF_PATH = {"NFF": "better", "FNF": "change", "NFN": "change", "NNF": "change", "FFN": "change",
                  "NNN": "non-FFH", "FNN": "worse"}
# ---------------------------------------


def group_size(sites: DataFrame, key: str = "plot") -> DataFrame:
    """Number of visits per plot on every row, kept where it is the largest of its plot.

    The filter runs inside the group, where ``count`` is constant, so it keeps
    every row (T3) - reproduced as is.  A plot has at most one row per survey
    year, so the window partition is bounded by the number of years.
    """
    w = Window.partitionBy(key)
    return (sites.withColumn("count", F.count(F.lit(1)).over(w))
            .withColumn("_max_count", F.max("count").over(w))
            .filter(F.col("count") == F.col("_max_count"))
            .drop("_max_count"))


def complete_plots(sites: DataFrame, key: str = "plot") -> DataFrame:
    """The evident intent of A25: keep plots surveyed as often as the most surveyed plot.

    The global maximum is a one-row aggregate; broadcasting it is bounded.
    """
    counts = sites.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    top = counts.agg(F.max("count").alias("_max"))
    keep = counts.join(F.broadcast(top), F.col("count") == F.col("_max")).select(key, "count")
    return sites.join(keep, key, "inner")


def year_columns(years: Sequence[int]) -> list[str]:
    """x17, x18, x19 style names (two-digit year)."""
    return [f"x{y % 100:02d}" for y in years]


def pivot_years(sites: DataFrame, years: Sequence[int], value: str = "ffh",
                key: str = "plot", year_col: str = "surveyYear") -> DataFrame:
    """One row per plot, one column per survey year (explicit values: no extra job)."""
    wide = sites.groupBy(key).pivot(year_col, list(years)).agg(F.max(value))
    return wide.select(key, *[F.col(f"`{y}`").alias(n) for y, n in zip(years, year_columns(years))])


def state(ffh: Column | str) -> Column:
    """N for a visit that is no FFH type, F for any FFH type, NULL for no visit."""
    c = F.col(ffh) if isinstance(ffh, str) else ffh
    return F.when(c == NON_FFH, "N").when(c != NON_FFH, "F")


def change_type(*ffh: Column | str) -> Column:
    """C22 on three consecutive years of the FFH class; a missing year gives NULL."""
    cols = [F.col(c) if isinstance(c, str) else c for c in ffh]
    path = F.concat(*[state(c) for c in cols])  # NULL as soon as one state is
    by_path = F.element_at(F.create_map(*[F.lit(x) for kv in CHANGE_OF_PATH.items() for x in kv]), path)
    same = F.lit(True)
    for c in cols[1:]:
        same = same & (c == cols[0])
    return F.when(path == "FFF", F.when(same, F.concat(F.lit("FFH"), cols[0])).otherwise(ANY_FFH)).otherwise(by_path)


def change_classes(sites: DataFrame, years: Sequence[int], key: str = "plot") -> DataFrame:
    """Per plot: the FFH class per year and the change class (the R7 pivot + C22)."""
    _three(years)
    wide = pivot_years(group_size(sites.select(key, "surveyYear", "ffh"), key), years, key=key)
    return wide.withColumn("changeType", change_type(*year_columns(years)))


def _three(years: Sequence[int]) -> None:
    if len(years) != 3:
        raise ValueError("the change rules are defined on exactly three survey years")


def with_change_type(sites: DataFrame, years: Sequence[int], key: str = "plot") -> DataFrame:
    """Every visit row with the change class of its plot, without a join.

    One exchange on the plot: its years meet in a window of at most one row per survey year.  A projection
    without ``changeType`` loses the window too.
    """
    _three(years)
    w = Window.partitionBy(key)
    of_year = [F.max(F.when(F.col("surveyYear") == y, F.col("ffh"))).over(w) for y in years]
    return (sites.withColumns({f"_ffh{i}": c for i, c in enumerate(of_year)})
            .withColumn("changeType", change_type(*[f"_ffh{i}" for i in range(3)]))
            .drop(*[f"_ffh{i}" for i in range(3)]))


def change_paths(sites: DataFrame, key: str = "plot") -> DataFrame:
    """R7 / C22 over any number of survey years, taken from the data.

    Per plot: path (N or F per survey year of the table, ``-`` for a year without a visit), n_years (with a visit),
    gains and losses (steps from N to F and back between consecutive visits), pathType.  pathType follows the three-year
    rules: one step, kept for the last two years, is better or worse, any other step is change; without a step the
    class itself, any-FFH if several FFH classes; NULL where a year is missing.

    The states of a plot are one small array, sorted by year and folded; a plot has one visit a year at most.
    """
    visits = sites.where(F.col("ffh").isNotNull()).select(key, "surveyYear", "ffh")
    years = sites.agg(F.array_sort(F.collect_set("surveyYear")).alias("y")).select("y").scalar()  # as many as survey years
    per = visits.groupBy(key).agg(F.collect_set(F.struct("surveyYear", "ffh")).alias("_v"))
    per = per.withColumn("_y", years).withColumn("_s", F.transform("_y", lambda y: F.array_max(F.transform(
        F.filter("_v", lambda v: v["surveyYear"] == y), lambda v: v["ffh"]))))
    letters = F.transform("_s", lambda s: F.coalesce(state(s), F.lit("-")))
    seen = F.filter(letters, lambda x: x != "-")
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("gains"), F.lit(0).alias("losses"))
    fold = F.aggregate(seen, start, lambda a, x: F.struct(
        x.alias("last"), (a["gains"] + F.when((a["last"] == "N") & (x == "F"), 1).otherwise(0)).alias("gains"),
        (a["losses"] + F.when((a["last"] == "F") & (x == "N"), 1).otherwise(0)).alias("losses")))
    p = per.select(key, "_s", F.array_join(letters, "").alias("path"), F.size(seen).alias("n_years"), fold.alias("_f"))
    steps, settled = F.col("_f.gains") + F.col("_f.losses"), F.substring("path", -2, 2)
    classes = F.array_distinct("_s")
    kind = (F.when(F.col("path").contains("-"), F.lit(None).cast("string"))
            .when((steps == 1) & (settled == "FF"), "better").when((steps == 1) & (settled == "NN"), "worse")
            .when(steps > 0, "change").when(F.col("path").startswith("N"), NON_FFH)
            .when(F.size(classes) == 1, F.concat(F.lit("FFH"), F.get(classes, 0))).otherwise(ANY_FFH))
    return p.select(key, "path", "n_years", F.col("_f.gains").alias("gains"), F.col("_f.losses").alias("losses"), kind.alias("pathType"))
