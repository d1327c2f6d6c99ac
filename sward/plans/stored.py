"""The analysis table stored for the dashboard: a click reads the files of its plots only.

Rows are laid out in hash buckets of the plot (partition folders), sorted by plot and year inside.  The
number of buckets is a folder level of its own, so a reader finds it in the table.  A list of plots
becomes a filter on the bucket folders before the scan is planned; a table of plots is joined on (bucket, plot),
which Spark turns into a runtime filter on the folders (dynamic partition pruning).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sward.operators.mapview import series_of
from sward.plans.pipeline import SITE_COLUMNS

#: Folders of the stored table; choose them so that one holds some 100 MB.
BUCKETS = 64


def bucket_of(plot: Column, buckets: int | Column) -> Column:
    return F.pmod(F.xxhash64(plot), buckets if isinstance(buckets, Column) else F.lit(buckets)).cast("int")


def write_stored(sites: DataFrame, path: str, buckets: int = BUCKETS) -> str:
    """Write an analysis table (one row per plot and year) in buckets of the plot; one exchange."""
    out = sites.withColumn("buckets", F.lit(buckets)).withColumn("bucket", bucket_of(F.col("plot"), buckets))
    (out.repartition(F.col("bucket")).sortWithinPartitions("bucket", "plot", "surveyYear")
     .write.mode("overwrite").partitionBy("buckets", "bucket").parquet(path))
    return path


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored table with its folder columns ``buckets`` and ``bucket``."""
    return spark.read.parquet(path)


def select_stored(table: DataFrame, ids: Iterable[str] | DataFrame | None, key: str = "plot") -> DataFrame:
    """P10 on the stored table: rows of the plots in ``ids`` (a list, or a table with ``key``); none for NULL or empty."""
    n = table.select("buckets").first()
    if n is None:
        return table
    if isinstance(ids, DataFrame):
        wanted = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("bucket", bucket_of(F.col(key), n[0]))
        return table.join(wanted, ["bucket", key], "left_semi")
    ids = list(dict.fromkeys(i for i in (ids or []) if i is not None))
    if not ids:
        return table.filter(F.lit(False))
    # constant expressions: folded before Spark prunes the folders
    return table.where(F.col("bucket").isin(*[bucket_of(F.lit(i), n[0]) for i in ids]) & F.col(key).isin(*ids))


def stored_series(spark: SparkSession, path: str, metric: str, ids: Iterable[str] | DataFrame | None,
                  domain: tuple[int, int] | None = None) -> DataFrame:
    """M3 from the stored table: the selected plots' series in year order."""
    return series_of(select_stored(read_stored(spark, path), ids), metric, ordered=True, domain=domain)


def stored_sites(spark: SparkSession, path: str, columns: Sequence[str] = SITE_COLUMNS) -> DataFrame:
    return read_stored(spark, path).select(*columns)
