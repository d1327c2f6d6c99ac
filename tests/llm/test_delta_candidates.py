"""Classes met by one hub: every similar pair is a candidate, unlike classes that share elements do not meet; sets are made for many texts at once."""
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sward.llm import common as C, neardup, paragraphs as P


@pytest.mark.parametrize("seed,pct,kind", [(1, 80, "long"), (2, 50, "long"), (3, 90, "binary")])
@pytest.mark.parametrize("matches", [1, 3])
def test_candidates(spark, seed, pct, kind, matches):
    rng = random.Random(seed)
    pool = [rng.randrange(-2**63, 2**63) for _ in range(70)]
    name = (lambda i: i) if kind == "long" else (lambda i: bytes([i]))
    sets = [frozenset(rng.sample(pool, 16))]  # the hub
    while len(sets) < 150:
        s = set(rng.choice(sets) if rng.random() < 0.25 else rng.sample(pool, rng.randrange(1, 25)))
        s ^= set(rng.sample(pool, rng.randrange(4)))
        if s and frozenset(s) not in sets:
            sets.append(frozenset(s))
    hub = sets[0]
    like = [len(s & hub) * 100 >= pct * len(s | hub) for s in sets]
    met = spark.createDataFrame([(name(0), name(i), len(s), len(hub), sorted(s ^ hub)) for i, s in enumerate(sets) if i],
                                f"hub {kind}, set_id {kind}, n long, hn long, delta array<long>").repartition(3)
    labels = spark.createDataFrame([(name(i), name(0)) for i in range(len(sets)) if like[i]], f"set_id {kind}, comp {kind}")
    got = {tuple(r) for r in neardup._delta_candidates(C.Scratch(spark, "delta"), met, labels, pct, matches).collect()}
    want = {(name(i), name(j)) for j in range(1, len(sets)) for i in range(1, j) if not (like[i] and like[j])
            and len(sets[i] & sets[j]) * 100 >= pct * len(sets[i] | sets[j])}
    assert {tuple(map(lambda x: x if kind == "long" else bytes(x), p)) for p in got} >= want and len(want) > 5
    assert len(got) <= 2 * len(want)  # hundreds share three of the rarest differences


def test_sets_of_many_texts():
    texts = [" ".join(f"w{d}x{i}" for i in range(n)) for d, n in enumerate((30, 4, 200, 0))] + [None, " ".join(f"z{i}" for i in range(40))]
    names = []
    for t in texts:
        *_, s, at = P._paragraphs(pa.array([t], pa.string()).cast(pa.large_binary()), 5)
        names.append([(bytes(C.set_digest(s[i:j])), s[i:j].view("i8").tolist()) for i, j in zip(at, at[1:])])
    wanted = [[{"set_id": x, "class": 10 * d + i} for i, (x, _) in enumerate(p) if i % 2 == 0] for d, p in enumerate(names)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(6)), pa.array(range(6)), pa.array(texts), pa.array(wanted, pa.list_(pa.struct([("set_id", pa.binary()), ("class", pa.int64())])))],
        ["doc_id", "th", "text", "wanted"])
    out = list(P._sets(5)(iter([batch.slice(1), batch.slice(0, 1)])))
    assert len(out) == 2  # one batch a slice of texts, not one a text
    got = {c: (n, s) for b in out for c, n, s in zip(*(b.column(x).to_pylist() for x in ("class", "n", "s")))}
    want = {10 * d + i: (len(s), s) for d, p in enumerate(names) for i, (_, s) in enumerate(p) if i % 2 == 0}
    assert got == want and len(want) > 5
