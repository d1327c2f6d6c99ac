"""Order-dependent operators that must not funnel a whole table (or a whole hot
group) through one task.

* ``row_sequence`` (W2, ``seq_along``): global 1..N numbering in key order.
* ``consecutive_pairs``: (previous, current) element pairs inside each group,
  in a given order - the basis of path lengths and ring areas (M7, M8).

Both range-partition on the full ordering key.  Range bounds are sampled on
the whole key, so one huge group is cut across several partitions instead of
landing in one task; the few pairs that straddle a partition boundary are
repaired from a per-partition summary (one row per partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LOCAL_BITS = 33  # monotonically_increasing_id: partition id in the upper bits, row index in the lower 33


def _num_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def ranged(df: DataFrame, order: Sequence[str], partitions: int | None = None, distinct: bool = False) -> DataFrame:
    """Range-partition on ``order``, optionally drop duplicate rows, sort each partition.

    The de-duplication needs no exchange of its own: range partitioning on a
    subset of the row's columns already clusters equal rows.

    Range bounds are sampled, so two executions may cut differently.  The layout
    is therefore written once to the shared folder, and every branch of a plan
    reads that table: results do not depend on exchange reuse.
    """
    from sward.session import shared_path
    n = partitions or _num_partitions(df)
    r = df.repartitionByRange(n, *order)
    if distinct:
        r = r.dropDuplicates()
    r = (r.sortWithinPartitions(*order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_local", F.monotonically_increasing_id()
                     - F.shiftleft(F.col("_pid").cast("bigint"), _LOCAL_BITS)))
    path = shared_path(df.sparkSession, "range-layout")
    r.write.parquet(path)
    return df.sparkSession.read.schema(r.schema).parquet(path)


def row_sequence(df: DataFrame, order: Sequence[str], name: str = "seq",
                 partitions: int | None = None) -> DataFrame:
    """Number all rows 1..N by ``order`` (ties broken by the order columns only).

    One range shuffle; the per-partition counts are a tiny aggregate whose
    running sum gives each partition's offset (bounded by the partition count,
    so the broadcast is bounded too).
    """
    r = ranged(df, order, partitions)
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    return (r.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_local") + 1)
            .drop("_pid", "_local", "_off"))


def ordered_layout(df: DataFrame, group: str, order: Sequence[str], values: Sequence[str],
                   partitions: int | None = None, distinct: bool = False) -> DataFrame:
    """The layout that :func:`segments_in_layout` reads: range-partitioned on (group, order),
    sorted and written, so a hot group is cut over several partitions (segments).
    """
    cols = list(dict.fromkeys([group, *order, *values]))
    src = df.select(*cols)
    return ranged(src, [group, *order], partitions, distinct)


def segments_in_layout(r: DataFrame, group: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One window pass over the layout: every row with its predecessor inside the
    (partition, group) segment, plus the segment's first / last values and size.

    A segment is the part of a group that fell into one range partition; a
    group spans several segments only when it is large (hot).
    """
    w = Window.partitionBy("_pid", group).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return r.select(
        group, "_pid", *values,
        *[F.lag(v).over(w).alias(f"p_{v}") for v in values],
        F.row_number().over(w).alias("_rn"),
        F.count(F.lit(1)).over(whole).alias("_seg_n"),
        *[F.first(v).over(whole).alias(f"_f_{v}") for v in values],
        *[F.last(v).over(whole).alias(f"_l_{v}") for v in values])


def pairs_and_segments(x: DataFrame, group: str, values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Consecutive pairs ``(group, p_<v>..., <v>...)`` and the segment table.

    Pairs across a partition boundary link the last row of one segment to the
    first row of the group's next segment; that window runs over segments,
    at most one per partition and group.
    """
    inner = x.filter(F.col("_rn") > 1).select(group, *[f"p_{v}" for v in values], *values)
    segs = x.filter(F.col("_rn") == 1).select(group, "_pid", "_seg_n", *[f"_f_{v}" for v in values],
                                              *[f"_l_{v}" for v in values])
    ws = Window.partitionBy(group).orderBy("_pid")
    cross = (segs.select(group, *[F.lag(f"_l_{v}").over(ws).alias(f"p_{v}") for v in values],
                         *[F.col(f"_f_{v}").alias(v) for v in values],
                         F.lag(F.lit(1)).over(ws).alias("_has_prev"))
             .filter(F.col("_has_prev").isNotNull()).drop("_has_prev"))
    return inner.unionByName(cross), segs


def pairs_in_layout(r: DataFrame, group: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """All (previous, current) pairs of consecutive rows within each ``group``.

    Output columns: ``group``, ``p_<v>`` and ``<v>`` for each value column.
    A group with one row yields no pair.
    """
    pairs, _ = pairs_and_segments(segments_in_layout(r, group, order, values), group, values)
    return pairs


def ends_from_segments(segs: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """First / last values and row count per group from its segments (hash-aggregable)."""
    return segs.groupBy(group).agg(
        F.sum("_seg_n").alias("n"),
        *[F.min_by(f"_f_{v}", "_pid").alias(f"first_{v}") for v in values],
        *[F.max_by(f"_l_{v}", "_pid").alias(f"last_{v}") for v in values])


def consecutive_pairs(df: DataFrame, group: str, order: Sequence[str], values: Sequence[str],
                      partitions: int | None = None, distinct: bool = False) -> DataFrame:
    """:func:`pairs_in_layout` over a fresh :func:`ordered_layout`."""
    r = ordered_layout(df, group, order, values, partitions, distinct)
    return pairs_in_layout(r, group, order, values)
