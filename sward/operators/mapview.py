"""Data side of the dashboard: marker and line layers, per-plot series and the
global reference statistics (W1, J1, M1-M6, A26, A27, C23, C24, P10, P15).

The reference recomputes mean and sd of the whole table three times per chart
and filters one clicked plot; here the statistics are one partial/final
aggregate (one row, so broadcasting it is bounded) and the series is a scan
with column pruning and a pushed-down plot filter.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sward.functions.rsem import html_escape, paste0, strip_number_text
from sward.operators.biotope import point_band

# ---- fixed values of the reference: metric -> y-axis limits of its chart ----
METRIC_LIMITS = {
    "speciesRichness": (0.0, 50.0),
    "biotopePoints": (0.0, 15.0),
    "rlgRichness": (0.0, 8.0),
}
DEFAULT_METRIC = "rlgRichness"
REFERENCE_SD_FACTOR = 0.5
# popup / label text pieces
POPUP_ID, POPUP_EXPOSITION, POPUP_SIDE = "ID: ", "Exposition: ", "Seite: "
LINE_BUILT, LINE_RENOVATED, LINE_LABEL_RENOVATED = "Baujahr: ", "Sanierung: ", ", Sanierung:"
# ------------------------------------------------------------------------------


def resolve_metric(metric: str) -> str:
    """The two named metrics select themselves, any other value falls back to rlgRichness."""
    return metric if metric in ("speciesRichness", "biotopePoints") else DEFAULT_METRIC


def first_visit(sites: DataFrame, key: str = "plot", order: Iterable[str] = ("surveyYear", "id"),
                cols: Iterable[str] = ("location", "exposition", "side")) -> DataFrame:
    """First row per plot in (year, id) order, as a partial aggregate (no sort)."""
    order, cols = list(order), list(cols)
    first = F.min(F.struct(*[F.col(c) for c in order + cols])).alias("_f")
    return sites.groupBy(key).agg(first).select(key, *[F.col(f"_f.{c}").alias(c) for c in order + cols])


def plot_layer(points: DataFrame, sites: DataFrame) -> DataFrame:
    """M1: point layer joined with first-visit attributes (J1), display id, popup and label.

    The canonical zero-padded ``plot`` stays the key; ``plot_display`` is the
    reference's number-stripped marker id used in the texts (T6).
    """
    attrs = first_visit(sites).drop("surveyYear", "id")
    p = points.select("plot", "lon", "lat").join(attrs, "plot", "left")
    disp = F.col("plot_display")
    return (p.withColumn("plot_display", strip_number_text("plot"))
            .withColumns({
                "popup": paste0(F.lit("<b>"), html_escape("location"), F.lit("</b>"), F.lit("<br/>"),
                                F.lit(POPUP_ID), html_escape(disp), F.lit("</b>"), F.lit("<br/>"),
                                F.lit(POPUP_EXPOSITION), html_escape("exposition"), F.lit("</b>"), F.lit("<br/>"),
                                F.lit(POPUP_SIDE), html_escape("side")),
                "label": paste0(F.col("location"), F.lit(" (ID: "), disp, F.lit(")")),
            }))


def line_layer(lines: DataFrame) -> DataFrame:
    """M2: line attributes with label and popup (NA written as text, HTML escaped)."""
    built, renovated = html_escape("BAUJAHR"), html_escape("SANIERUNG")
    return lines.withColumns({
        "label": paste0(F.lit(LINE_BUILT), built, F.lit(LINE_LABEL_RENOVATED), renovated),
        "popup": paste0(F.lit(LINE_BUILT), built, F.lit("<br/>"), F.lit(LINE_RENOVATED), renovated),
    })


def select_plots(df: DataFrame, ids: Iterable[str] | DataFrame | None, key: str = "plot") -> DataFrame:
    """P10 ``plot %in% ids``: NULL or empty selection -> no rows; a DataFrame of ids -> semi join."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key).distinct(), key, "left_semi")
    ids = [i for i in (ids or []) if i is not None]
    if not ids:
        return df.filter(F.lit(False))
    return df.filter(F.col(key).isin(*ids))


def in_range(y: Column, metric: str, year: Column | None = None, domain: tuple[int, int] | None = None) -> Column:
    """Inside the chart's axis limits, and inside the ``domain`` of survey years if one is given."""
    lo, hi = METRIC_LIMITS[metric]
    inside = (y >= lo) & (y <= hi)
    return inside if domain is None else inside & (year >= domain[0]) & (year <= domain[1])


def one_row_per_plot(layer: DataFrame, key: str = "plot") -> DataFrame:
    """M1's check: the marker layer itself, failing at run time where a plot has more than one marker."""
    w = Window.partitionBy(key)
    n = F.count(F.lit(1)).over(w)
    fail = F.raise_error(F.concat(F.lit("more than one marker for plot "), F.coalesce(F.col(key), F.lit("NULL"))))
    return (layer.withColumn("_n", n).where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(fail.cast("boolean")))
            .drop("_n"))


def plot_series(sites: DataFrame, metric: str, ids: Iterable[str] | DataFrame | None, ordered: bool = False,
                domain: tuple[int, int] | None = None) -> DataFrame:
    """M3: (metric, selected plots) -> location, plot, surveyYear, y, biotopeType, in_range, title.

    ``ordered``: sorted by plot and year, as the chart draws them (W6), with ``seq``, the place in the plot's series.
    """
    return series_of(select_plots(sites, ids), metric, ordered, domain)


def series_of(selected: DataFrame, metric: str, ordered: bool = False, domain: tuple[int, int] | None = None) -> DataFrame:
    """The series columns of rows that are already selected."""
    m = resolve_metric(metric)
    out = selected.select("location", "plot", "surveyYear", F.col(m).alias("y"), "biotopeType").withColumns({
        "in_range": in_range(F.col("y"), m, F.col("surveyYear"), domain),
        "title": paste0(html_escape("location"), F.lit(". ID: "), html_escape("plot")),
    })
    if not ordered:
        return out
    seq = F.row_number().over(Window.partitionBy("plot").orderBy("surveyYear"))  # a plot has one row a year
    return out.withColumn("seq", seq).orderBy("plot", "surveyYear")


def reference_stats(sites: DataFrame, metric: str) -> DataFrame:
    """M4 (A26 + A27): mean, mean +- 0.5 sd of the whole table and the year domain, one row.

    R's mean/sd return NA as soon as one input is NA: guarded by count(y) = count(*).
    """
    m = resolve_metric(metric)
    y = F.col(m).cast("double")
    complete = F.count(y) == F.count(F.lit(1))
    mean = F.when(complete, F.avg(y))
    sd = F.when(complete, F.stddev_samp(y))
    return (sites.agg(mean.alias("mean"), sd.alias("_sd"),
                      F.min("surveyYear").alias("x_min"), F.max("surveyYear").alias("x_max"))
            .select(F.lit(m).alias("metric"), "mean",
                    (F.col("mean") + F.lit(REFERENCE_SD_FACTOR) * F.col("_sd")).alias("upper"),
                    (F.col("mean") - F.lit(REFERENCE_SD_FACTOR) * F.col("_sd")).alias("lower"),
                    "x_min", "x_max"))


def series_with_reference(sites: DataFrame, metric: str, ids: Iterable[str] | DataFrame | None) -> DataFrame:
    """Series rows with the global statistics attached.

    The statistics are one struct-valued scalar subquery (one aggregate job,
    reused for every field), evaluated once and inlined into the projection:
    no join and no cross product.
    """
    stats = reference_stats(sites, metric)
    fields = ["mean", "upper", "lower", "x_min", "x_max"]
    scalar = stats.select(F.struct(*fields).alias("s")).scalar()
    series = plot_series(sites, metric, ids)
    return (series.withColumn("_ref", scalar)
            .select(*series.columns, *[F.col(f"_ref.{f}").alias(f) for f in fields]))


def series_with_bands(sites: DataFrame, ids: Iterable[str] | DataFrame | None) -> DataFrame:
    """M5: the biotope-points series with the chart band of each point."""
    return plot_series(sites, "biotopePoints", ids).withColumn("band", point_band(F.col("y")))


def reference_stats_all(sites: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """M4 for several metrics in one pass: one aggregate, then one row per metric."""
    metrics = list(dict.fromkeys(resolve_metric(m) for m in metrics))
    aggs = [F.min("surveyYear").alias("x_min"), F.max("surveyYear").alias("x_max"),
            F.count(F.lit(1)).alias("_n")]
    for m in metrics:
        y = F.col(m).cast("double")
        aggs += [F.count(y).alias(f"_c_{m}"), F.avg(y).alias(f"_a_{m}"), F.stddev_samp(y).alias(f"_s_{m}")]
    one = sites.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"),
                 F.when(F.col(f"_c_{m}") == F.col("_n"), F.col(f"_a_{m}")).alias("mean"),
                 F.when(F.col(f"_c_{m}") == F.col("_n"), F.col(f"_s_{m}")).alias("sd"))
        for m in metrics]))
    return (one.select("x_min", "x_max", rows.alias("_r"))
            .select(F.col("_r.metric").alias("metric"), F.col("_r.mean").alias("mean"),
                    (F.col("_r.mean") + F.lit(REFERENCE_SD_FACTOR) * F.col("_r.sd")).alias("upper"),
                    (F.col("_r.mean") - F.lit(REFERENCE_SD_FACTOR) * F.col("_r.sd")).alias("lower"),
                    "x_min", "x_max"))
