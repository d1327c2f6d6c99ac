"""Species list checks over the cover table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def species_present(cover: DataFrame, value: str = "n", scale: float = 1.0) -> DataFrame:
    """Total cover per species over all visits; keep species with total > 0.

    ``presence = if_else(total > 0, 1, 0)`` then ``filter(presence == 1)``.
    """
    total = (F.coalesce(F.sum(value), F.lit(0)).cast("double") / F.lit(float(scale)))
    return (cover.groupBy("name").agg(total.alias("total"))
            .withColumn("presence", (F.col("total") > 0).cast("int"))
            .filter(F.col("presence") == 1))


def species_frequency(cover: DataFrame, value: str = "n") -> DataFrame:
    """Per species the number of visits where its cover is not 0 (F16 ``1 * (n != 0)``)."""
    return cover.groupBy("name").agg(F.count_if(F.col(value) != 0).alias("frequency"))
