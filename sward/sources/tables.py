"""Readers for the driver's Parquet tables.

Only ``spark.read.parquet`` is used: the projection and the filters written
downstream reach the scan (``ReadSchema`` / ``PushedFilters``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# TPC-H fixes these dimension sizes independent of the scale factor, which is
# the size proof that allows a broadcast hint on them.
FIXED_SIZE_TABLES = {"region": 5, "nation": 25}




def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan of one driver table, the same for every kind of path."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
