"""Factor columns (W4, W5): codes in the order of first appearance in the files.

A value's first appearance is the smallest (file, row position) that holds it, taken from the
scan's ``_metadata``, not from a sort key of the data and not from the order in which tasks
run: codes do not depend on splits or partition counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sward.operators.sequence import row_sequence


def with_position(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Columns of a Parquet table and ``_at``: the row's file and its place in it."""
    return spark.read.parquet(path).select(*columns, F.struct(F.col("_metadata.file_path").alias("file"),
                                                              F.col("_metadata.row_index").alias("row")).alias("_at"))


def factor_levels(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(factor, value, code): the distinct values of each column, code 1, 2, ... by first appearance (NULL has none).

    One scan and one partial aggregate for all columns; the levels are numbered over a range layout, so a
    column with very many levels is no single-task sort.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("value")) for c in columns]))
    first = (rows.select(pairs.alias("_p"), "_at").select("_p.*", "_at").where("value is not null")
             .groupBy("factor", "value").agg(F.min("_at").alias("_at"))
             .select("factor", "value", F.col("_at.file").alias("_file"), F.col("_at.row").alias("_row")))
    seq = row_sequence(first, ["factor", "_file", "_row"], "_seq")
    start = seq.groupBy("factor").agg(F.min("_seq").alias("_low"))  # one row a column
    return seq.join(start, "factor").select("factor", "value", (F.col("_seq") - F.col("_low") + 1).cast("int").alias("code"))


def encode_factors(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``<column>_code`` for every factor column; the dictionaries are joined by value."""
    levels = factor_levels(rows, columns)
    out = rows
    for c in columns:
        codes = levels.where(F.col("factor") == c).select(F.col("value").alias(f"_{c}"), F.col("code").alias(f"{c}_code"))
        # no hint: a dictionary may be large, Spark's size check and AQE pick the join and split hot values
        out = out.join(codes, F.col(c).cast("string") == F.col(f"_{c}"), "left").drop(f"_{c}")
    return out.drop("_at")
