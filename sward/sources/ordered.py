"""Sorted tables (W6): a total-order sink with a manifest of key ranges, read back in order.

Rows are range-partitioned on the sort key and sorted; each range is a folder with its rows' places.
The manifest holds one row per range: its smallest and largest key, its size, and how many rows come
before it.  A reader has every row's position without sorting, and a key range reads its folders only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, key: str, partitions: int | None = None) -> str:
    """Write ``df`` in the order of ``key`` (NULL first); rows of one key are in any order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (df.repartitionByRange(n, key).sortWithinPartitions(key)
            .withColumn("part", F.spark_partition_id())
            .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/data")
    spark = df.sparkSession
    # an empty table has no folders to read
    data = spark.read.schema(rows.schema).parquet(f"{path}/data")
    ranges = data.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges.withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")  # one row a range
    return path


def read_sorted(spark: SparkSession, path: str, lo=None, hi=None, key: str | None = None) -> DataFrame:
    """The rows and ``position`` (from 1); with ``key``, those from ``lo`` to ``hi`` (None: open), from their folders only."""
    data, manifest = spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/manifest")
    if key:
        hit = manifest
        if lo is not None:
            hit, data = hit.where(F.col("hi") >= F.lit(lo)), data.where(F.col(key) >= F.lit(lo))
        if hi is not None:
            hit, data = hit.where(F.col("lo") <= F.lit(hi)), data.where(F.col(key) <= F.lit(hi))
        data = data.where(F.col("part").isin([r[0] for r in hit.select("part").collect()]))  # as many as ranges
    # one row for each range: at most the partitions of the write
    return (data.join(F.broadcast(manifest.select("part", "before")), "part")
            .withColumn("position", F.col("before") + F.col("place") + 1).drop("part", "place", "before"))
