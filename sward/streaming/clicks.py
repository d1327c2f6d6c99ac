"""The dashboard's click -> chart loop (E3) as a Structured Streaming job.

In the reference a marker click re-runs the series query for the clicked plot
and the chosen metric.  Here click events ``(plot, metric, ts)`` arrive as
files in a folder; each micro-batch is joined to the analysis table written by
the batch pipeline (a static Parquet table, so E1 is not recomputed per
batch) and the series rows are appended to a Parquet sink.

Exactly-once: the source offsets live in the checkpoint folder and every
micro-batch overwrites its own ``batch=<id>`` folder, so a replay after a lost
executor or driver rewrites the same files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sward.operators.mapview import DEFAULT_METRIC, METRIC_LIMITS
from sward.session import shared_path

CLICK_SCHEMA = "plot STRING, metric STRING, ts TIMESTAMP"


def metric_value_sql(metric: str = "metric") -> str:
    """P15 per row: the named metric column, any other value -> rlgRichness."""
    return (f"CASE {metric} WHEN 'speciesRichness' THEN speciesRichness "
            f"WHEN 'biotopePoints' THEN biotopePoints ELSE {DEFAULT_METRIC} END")


def resolved_metric_sql(metric: str = "metric") -> str:
    return f"CASE WHEN {metric} IN ('speciesRichness', 'biotopePoints') THEN {metric} ELSE '{DEFAULT_METRIC}' END"


def in_range_sql(metric: str = "metric", y: str = "y") -> str:
    whens = " ".join(f"WHEN '{m}' THEN {y} >= {lo} AND {y} <= {hi}" for m, (lo, hi) in METRIC_LIMITS.items())
    return f"CASE {metric} {whens} END"


def series_for_clicks(clicks: DataFrame, sites: DataFrame) -> DataFrame:
    """M3 for a batch of clicks: every clicked (plot, metric) with its series rows."""
    c = clicks.select("plot", F.expr(resolved_metric_sql()).alias("metric"), "ts")
    s = sites.select("plot", "location", "surveyYear", "speciesRichness", "biotopePoints", "rlgRichness",
                     "biotopeType")
    # A micro-batch has no size statistics, so without a hint Spark would shuffle the whole
    # analysis table for every batch.  The click side is bounded by the source's
    # maxFilesPerTrigger (and a UI emits one small event per click): broadcast it.
    j = F.broadcast(c).join(s, "plot")
    j = j.withColumn("y", F.expr(metric_value_sql()))
    return j.select(
        "ts", "metric", "location", "plot", "surveyYear", "y", "biotopeType",
        F.expr(in_range_sql()).alias("in_range"),
        F.expr("concat(coalesce(replace(replace(replace(location, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), 'NA'),"
               " '. ID: ', coalesce(replace(replace(replace(plot, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), 'NA'))")
        .alias("title"))


def click_stream(spark: SparkSession, clicks_dir: str, max_files_per_trigger: int = 64) -> DataFrame:
    """Streaming source of click events (JSON lines); the file cap bounds each micro-batch."""
    return (spark.readStream.schema(CLICK_SCHEMA)
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .json(clicks_dir))


def run_click_series(spark: SparkSession, sites_path: str, clicks_dir: str, out_dir: str,
                     checkpoint: str | None = None, available_now: bool = True):
    """Start the streaming job; with ``available_now`` it drains the folder and stops."""
    sites = spark.read.parquet(sites_path)
    checkpoint = checkpoint or shared_path(spark, "click-series-checkpoint")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (series_for_clicks(batch, sites).write.mode("overwrite")
         .parquet(os.path.join(out_dir, f"batch={batch_id}")))

    writer = (click_stream(spark, clicks_dir).writeStream
              .foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")
    return writer.start()
