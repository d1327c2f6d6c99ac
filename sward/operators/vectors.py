"""Visits as sparse vectors over the species (R5), the transpose without pivot columns.

A vector is cut into blocks of species; a block is one row with sorted places and their values.
So the transpose is as wide as the species list without any wide row or column, and operations are
array folds in a block and sums over blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Species of one block, at most so many entries of a row.
BLOCK = 1 << 16


def visit_vectors(cover: DataFrame, keys: Sequence[str], species: str = "name", value: str = "n", block: int = BLOCK) -> DataFrame:
    """(keys..., block, places, values): the non-zero covers of a visit, places ascending inside the block.

    ``species`` is a non-negative integer key; a (visit, species) occurs once.
    """
    cells = F.array_sort(F.collect_list(F.struct((F.col(species) % block).cast("int").alias("i"), F.col(value).cast("double").alias("x"))))
    return (cover.where(F.col(value) != 0).groupBy(*keys, F.floor(F.col(species) / block).alias("block")).agg(cells.alias("_c"))
            .select(*keys, "block", F.col("_c.i").alias("places"), F.col("_c.x").alias("values")))


def fold(values: Column, f) -> Column:
    """Sum of f(x) over an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x))


def vector_summary(vectors: DataFrame, keys: Sequence[str], block: int = BLOCK, scale: float = 1.0) -> DataFrame:
    """Per visit: n_species, total, first_species, last_species and Shannon's H (A21), from block sums.

    H = ln S - sum(x ln x) / S over the positive values, S their sum.
    """
    positive = F.filter("values", lambda x: x > 0)
    parts = vectors.select(*keys, F.size("places").alias("n"), fold(F.col("values"), lambda x: x).alias("t"),
                           fold(positive, lambda x: x).alias("s"), fold(positive, lambda x: x * F.ln(x)).alias("e"),
                           (F.col("block") * block + F.get("places", 0)).alias("lo"),
                           (F.col("block") * block + F.element_at("places", -1)).alias("hi"))
    s, e = F.sum("s"), F.sum("e")
    return parts.groupBy(*keys).agg(F.sum("n").cast("int").alias("n_species"), (F.sum("t") / F.lit(float(scale))).alias("total"),
                                    F.min("lo").alias("first_species"), F.max("hi").alias("last_species"),
                                    F.when(s == 0, 0.0).otherwise(F.ln(s) - e / s).alias("shannon"))
