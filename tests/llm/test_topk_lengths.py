"""Vectors of several lengths: each is ranked among those of its own length, against plain Python."""
import random
from math import floor

from pyspark.sql import functions as F


def test_lengths_are_ranked_apart(spark):
    from sward.llm.topk import top_k
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(rng.choice([0, 2, 3, 3]))]) for i in range(60)] + [(60, None), (61, [1.0, None])]
    got = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in top_k(spark, df, F.col("vec_id") % 5 == 0, k=4, shard_rows=16, block_queries=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = {i: [floor(1024 * x) for x in v] for i, v in rows if v is not None and None not in v}
    for i in [i for i in q if i % 5 == 0]:
        found = sorted((-sum(a * b for a, b in zip(q[i], v)), j) for j, v in q.items() if j != i and len(v) == len(q[i]))[:4]
        assert sorted(got.pop(i, [])) == [(n + 1, j, -s) for n, (s, j) in enumerate(found)], i
    assert not got
