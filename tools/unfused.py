"""The 22 separate metric tables of the unfused form, for the equivalence test and the benchmark."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sward.functions.rsem import r_round_sql, sql_double
from sward.operators.metrics import GRAMINOID_FAMILIES, _in, cover_predicates, richness_predicates


def unfused_metrics(joined: DataFrame, keys: Sequence[str], value: str = "n",
                    scale: float = 1.0) -> DataFrame:
    """One filtered aggregate per metric, joined back on the keys.

    Works on the trait columns.  Kept for the equivalence test only.
    """
    v = f"`{value}`"
    sc = sql_double(scale)
    gram = _in("family", GRAMINOID_FAMILIES)
    out = (joined.groupBy(*keys)
           .agg(F.expr(f"CAST(coalesce(sum(CASE WHEN {gram} THEN {v} END), 0) AS DOUBLE) / {sc}").alias("graminoidCov"),
                F.expr(f"CAST(coalesce(sum(CASE WHEN NOT ({gram}) THEN {v} END), 0) AS DOUBLE) / {sc}").alias("herbCov")))
    for name, pred in cover_predicates().items():
        part = (joined.filter(F.expr(pred)).groupBy(*keys)
                .agg(F.expr(r_round_sql(f"CAST(coalesce(sum({v}), 0) AS DOUBLE) / {sc}", 1)).alias(name)))
        out = out.join(part, list(keys), "left").fillna(0.0, subset=[name])
    for name, pred in richness_predicates().items():
        part = (joined.filter(F.expr(f"{v} > 0 AND {pred}")).groupBy(*keys)
                .agg(F.count(F.lit(1)).cast("int").alias(name)))
        out = out.join(part, list(keys), "left").fillna(0, subset=[name])
    return out.withColumn("accumulatedCov", F.col("graminoidCov") + F.col("herbCov"))
