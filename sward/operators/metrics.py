"""Fused per-visit metrics: covers (A1-A9), richness (A10-A20) and Shannon.

The reference computes 8 cover and 14 richness tables with one filtered
aggregate each and right-joins them back (22 passes, 22 joins).  Here all of
them are one conditional ``groupBy(visit).agg(...)``: one scan of the cover
table, one partial aggregate before the shuffle, one exchange on the visit key.

The metric set is declared as data (name -> predicate) so the plan is
generated, not hand-written per metric.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sward.functions.rsem import r_round_sql, sql_double

# ---- fixed values of the reference (must stay equal for equal results) ----
GRAMINOID_FAMILIES = ("Poaceae", "Cyperaceae", "Juncaceae")
RED_LIST_CATEGORIES = ("1", "2", "3", "V")
TABLE33_COVER_CLASSES = ("2", "3", "4")
# ---------------------------------------------------------------------------


def _in(col: str, values) -> str:
    return f"{col} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


def cover_predicates() -> dict[str, str]:
    """Cover sums (rounded to 1 digit in the reference): name -> species predicate (SQL)."""
    return {
        "targetCov": "target = 'yes'",
        "targetHerbCov": "targetHerb = 'yes'",
        "arrhCov": "targetArrhenatherion = 'yes'",
        "leanCov": "leanIndicator = 'yes'",
        "nitrogenCov": "nitrogenIndicator = 'yes'",
        "ruderalCov": "ruderalIndicator = 'yes'",
        "table33Cov": _in("table33", TABLE33_COVER_CLASSES),
    }


def richness_predicates() -> dict[str, str]:
    """Richness counts (species with cover > 0): name -> species predicate (SQL)."""
    return {
        "speciesRichness": "true",
        "rlgRichness": _in("rlg", RED_LIST_CATEGORIES),
        "rlbRichness": _in("rlb", RED_LIST_CATEGORIES),
        "targetRichness": "target = 'yes'",
        "targetHerbRichness": "targetHerb = 'yes'",
        "arrhRichness": "targetArrhenatherion = 'yes'",
        "ffh6510Richness": "ffh6510 = 'yes'",
        "ffh6210Richness": "ffh6210 = 'yes'",
        "leanIndicatorRichness": "leanIndicator = 'yes'",
        "table33_2Richness": "table33 = '2'",
        "table33_3Richness": "table33 = '3'",
        "table33_4Richness": "table33 = '4'",
        "table34_2Richness": "table34 = '2'",
        "table34_3Richness": "table34 = '3'",
    }


COVER_NAMES = ("targetCov", "targetHerbCov", "arrhCov", "leanCov", "nitrogenCov", "ruderalCov", "table33Cov")
RICHNESS_NAMES = ("speciesRichness", "rlgRichness", "rlbRichness", "targetRichness", "targetHerbRichness",
                  "arrhRichness", "ffh6510Richness", "ffh6210Richness", "leanIndicatorRichness",
                  "table33_2Richness", "table33_3Richness", "table33_4Richness",
                  "table34_2Richness", "table34_3Richness")


def species_cover(cover: DataFrame, traits: DataFrame, value: str = "n") -> DataFrame:
    """Left join of the long cover table with the species traits.

    Run on the cover already aggregated per (visit, species): a hot species
    then has one row per visit, not one per input row.  No broadcast hint: the
    trait table grows with the data, so Spark's own size check (static
    threshold, then AQE's runtime sizes) decides between broadcast and
    shuffle join.
    """
    return cover.join(traits, "name", "left")


def predicate_bits() -> dict[str, str]:
    """Every species predicate the metrics test, in a fixed bit order.

    Traits are per species (the small side); encoding their predicates as one
    int keeps the joined visit x species rows compact: (visit, value, mask).
    """
    gram = _in("family", GRAMINOID_FAMILIES)
    bits = {"graminoid": gram, "herb": f"NOT ({gram})"}
    bits.update({f"cov:{k}": v for k, v in cover_predicates().items()})
    bits.update({f"rich:{k}": v for k, v in richness_predicates().items() if v != "true"})
    return bits


def mask_sql() -> str:
    """SQL of the trait bitmask; a NULL predicate counts as false (R's filter drops NA)."""
    return " | ".join(f"(CASE WHEN coalesce({p}, false) THEN {1 << i} ELSE 0 END)"
                      for i, p in enumerate(predicate_bits().values()))


def trait_masks(traits: DataFrame) -> DataFrame:
    """(name, _mask): one int per species."""
    return traits.select("name", F.expr(mask_sql()).cast("int").alias("_mask"))


def metric_aggregates(value: str = "n", scale: float = 1.0, mask: str = "_mask") -> list[str]:
    """The fused aggregate list as Spark SQL text over (value, trait bitmask)."""
    v = f"`{value}`"
    sc = sql_double(scale)
    bit = {name: 1 << i for i, name in enumerate(predicate_bits())}
    m = f"coalesce(`{mask}`, 0)"   # species without a trait record: no predicate holds

    def has(name: str) -> str:
        return f"({m} & {bit[name]}) != 0"

    def scaled_sum(name: str) -> str:
        # R: sum(na.rm = TRUE) of nothing is 0
        return f"(CAST(coalesce(sum(CASE WHEN {has(name)} THEN {v} END), 0) AS DOUBLE) / {sc})"

    aggs = [f"{scaled_sum('graminoid')} AS graminoidCov",
            # a NULL family satisfies neither side: its cover stays out of both groups
            f"{scaled_sum('herb')} AS herbCov"]
    aggs += [f"{r_round_sql(scaled_sum('cov:' + name), 1)} AS {name}" for name in cover_predicates()]
    for name, p in richness_predicates().items():
        cond = f"{v} > 0" if p == "true" else f"{v} > 0 AND {has('rich:' + name)}"
        aggs.append(f"CAST(count_if({cond}) AS INT) AS {name}")
    # Shannon: H = ln S - sum(n ln n) / S over cells with n > 0 (p = n / S is scale free)
    total = f"sum(CASE WHEN {v} > 0 THEN CAST({v} AS DOUBLE) END)"
    nlogn = f"sum(CASE WHEN {v} > 0 THEN CAST({v} AS DOUBLE) * ln(CAST({v} AS DOUBLE)) END)"
    aggs.append(f"CASE WHEN coalesce({total}, 0D) = 0D THEN 0D ELSE ln({total}) - {nlogn} / {total} END AS shannon")
    return aggs


def fused_metrics(joined: DataFrame, keys: Sequence[str], value: str = "n",
                  scale: float = 1.0) -> DataFrame:
    """All visit metrics in one conditional aggregate.

    ``joined`` has one row per visit and species with the cover ``value`` and
    either the trait columns or their ``_mask`` (see :func:`trait_masks`).
    Sums are taken on ``value`` exactly and divided by ``scale`` only
    afterwards, so threshold comparisons do not depend on summation order.

    Output per visit: graminoidCov, herbCov, accumulatedCov (unrounded), the
    seven rounded cover sums, fourteen richness counts and Shannon's H.
    """
    if "_mask" not in joined.columns:
        joined = joined.withColumn("_mask", F.expr(mask_sql()).cast("int"))
    aggs = [F.expr(a) for a in metric_aggregates(value, scale)]
    return (joined.groupBy(*keys).agg(*aggs)
            .withColumn("accumulatedCov", F.col("graminoidCov") + F.col("herbCov")))
