"""Running totals over a total order, without a single-task window.

The rows are range-partitioned on the whole order, sorted, given a running total
inside their partition and written once; the totals of the partitions (one row for
each partition and group) are then added.  A group that holds most of all rows is
cut over many partitions, as the order goes on inside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sward.llm.common import Scratch


def _local_totals(value: str, group: tuple):
    def run(batches):
        part = TaskContext.get().partitionId()
        last, total = None, 0  # the group of the row before, and its total so far
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            v = b.column(value).to_numpy().astype(np.int64)
            new = np.zeros(n, dtype=bool)
            for g in group:
                c = b.column(g)
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            first = tuple(b.column(g)[0].as_py() for g in group)
            new[0] = first != last
            before = np.cumsum(v) - v
            heads = np.flatnonzero(new)
            start = np.zeros(n, dtype=np.int64)
            start[heads] = before[heads]
            base = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            out = before + np.where(base >= 0, -start[np.maximum(base, 0)], total)
            total, last = int(out[-1] + v[-1]), tuple(b.column(g)[n - 1].as_py() for g in group)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(out)],
                                             [*b.schema.names, "_part", "_local"])
    return run


def running_total(scratch: Scratch, df: DataFrame, order: list, value: str, group: tuple = (),
                  partitions: int | None = None) -> DataFrame:
    """``df`` and ``before``: the sum of ``value`` (long, not NULL) over the earlier rows of the same group.

    ``order``: columns or expressions that start with the group's columns (never NULL) and leave only
    interchangeable rows tied.  ``df`` is computed twice (range bounds, then rows): pass a written table.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    layout = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    layout = scratch.save(layout.mapInArrow(_local_totals(value, group), f"{fields}, _part int, _local long"), "ranged")
    sums = layout.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    return (layout.join(offsets, ["_part", *group])
            .select(*df.columns, (F.col("_local") + F.col("_offset")).alias("before")))
