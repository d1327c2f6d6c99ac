"""Whitening, importance resampling and mixing against brute force, their oracles, and odd tables."""
import hashlib
import math
import os
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.mark.parametrize("name", ["op12_resample", "op13_mixing"])
def test_oracle(spark, name):
    from check_oracle import compare, duck
    from sward.llm.queries import ORACLE, QUERIES
    assert compare(spark, SF_SMALL, name, QUERIES[name], ORACLE[name], duck(SF_SMALL))


# ------------------------------------------------------------------ whitening
def test_scatter_is_exact():
    from sward.llm.whitening import scatter
    rng = np.random.default_rng(4)
    for high in (1, 300, 1 << 40, 1 << 62):
        x = rng.integers(-high, high, size=(333, 6))
        x[:, 2] = 5
        n, s, c = scatter(x)
        whole = x.astype(object)
        assert n == 333 and (s == whole.sum(axis=0)).all() and (c == whole.T @ whole).all()


def test_whitening_brute_force(spark):
    from sward.llm.whitening import whiten
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 6)) * np.array([1, 2, 3, 4, 500, 6])
    v[20:60] = v[7]  # one vector holds a fifth of the rows
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(7, v[7].tolist()), (None, v[1].tolist())]
    odd = [(300, None), (301, [1.0] * 5 + [None]), (302, [math.nan] + [1.0] * 5), (303, [math.inf] + [1.0] * 5), (304, [1.0] * 3),
           (305, []), (306, [1e300] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns(
        {"component": F.lit("x"), "n": F.lit(0), "x": F.lit(1), "v": F.lit(2)}).repartition(5)
    got = whiten(spark, df).collect()
    x = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    cov = (n * u.T @ u - np.outer(s, s)) / n ** 2
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1][:4], w[:, ::-1][:, :4]
    y = (x - s / n) @ w / np.sqrt(e)
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    sign = {k: np.sign(by[(0, k)][0]["whitened"] * y[0, k - 1]) for k in range(1, 5)}
    for i, (vec_id, _) in enumerate(rows):
        for k in range(1, 5):
            for r in by[(vec_id, k)]:
                assert abs(r["whitened"] - sign[k] * y[i, k - 1]) < 1e-9
                assert r["deviation"] == int(((n * x[i] - s) ** 2).sum())
                assert abs(r["explained"] - e[k - 1] / np.trace(cov)) < 1e-12 and r["identity_error"] < 1e-9
    assert len(by[(7, 1)]) == 2 and len(by[(None, 1)]) == 1


def test_whitening_deviation_in_python_integers():
    from sward.llm.whitening import Whitener
    x = np.array([[1 << 20, 3], [-(1 << 20), 5], [7, 1 << 21]])
    for n, sums in ((3, [7, (1 << 21) + 8]), (1 << 12, [1 << 30, 5]), (1 << 40, [1 << 60, 9])):
        m = Whitener.__new__(Whitener)
        m.n, m.sums, m.dims = n, sums, 2
        want = [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in x]
        assert m.deviation(x) == [v if v < 1 << 63 else None for v in want]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_whitening_without_variance(spark, rows):
    from sward.llm.whitening import whiten
    assert whiten(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


# ------------------------------------------------------------------ resampling
def test_gram_crcs():
    from sward.llm.resample import Segments
    texts = ["one two\nthree 4four, five\n\nsix", "", "Ünï ☃ " + "x" * 70 + " y " + "z" * 40_000 + " tail", "a", "b c"]
    s = Segments(pa.array(texts))
    inside, across = s.grams(1 << 32)
    got = sorted((int(s.row[i]), int(c)) for kind in (inside, across) for c, i in zip(*kind))
    want = []
    for r, t in enumerate(texts):
        w = words(t)
        want += [(r, zlib.crc32(b" ".join(w[i:i + k]))) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    assert got == sorted(want)


def words(text):
    import re
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def brute_resample(docs, target, min_words=20, percent=5):
    def feats(t):
        w = words(t)
        return [zlib.crc32(b" ".join(w[i:i + k])) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for x in texts:
            for b in feats(x):
                counts[b] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for d, x in docs:
        f = feats(x)
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((d, len(f), weight, weight + noise, len(words(x)) >= min_words))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(able[:percent * len(able) // 100])}
    return sorted((*r[:4], rank.get(r[0])) for r in out)


def test_resample_brute_force(spark):
    from sward.llm.resample import resample
    rng = random.Random(11)
    lines = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(9))) + rng.choice(["", " ", ".", " Ä"]) for _ in range(40)]
    docs = [(i, "\n".join(rng.choice(lines + ["w1 w2 common line"] * 20) for _ in range(rng.randrange(12)))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, " ".join(f"q{i % 977}" for i in range(30_000))), (1004, "!!! ???")]
    target = ["w1 w2 w3", "w5 Ä\nw7", None, "q1 q2 q3"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"line": F.lit("x"), "bucket": F.lit(1), "score": F.lit(2)})
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    for p in (5, 50):
        got = resample(spark, df.repartition(7), bench, percent=p)
        assert sorted(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == \
            brute_resample(docs, target, percent=p)


def test_resample_edges(spark):
    from sward.llm.resample import resample
    schema = "doc_id long, text string"
    none, long = spark.createDataFrame([], schema), " ".join(f"w{i}" for i in range(25))
    assert resample(spark, none, none).collect() == []
    docs = spark.createDataFrame([(None, long), (1, long), (1, long), (2, long), (3, None)], schema)
    got = resample(spark, docs, none, percent=67).collect()  # two of the three rows with an id
    assert sorted(((r["doc_id"], r["rank"]) for r in got if r["doc_id"] in (1, 2)), key=str) in (
        [(1, 1), (1, 2), (2, None)], [(1, 2), (1, None), (2, 1)])
    assert [(r["score"], r["rank"], r["n_features"]) for r in got if r["doc_id"] is None] == [(None, None, 72)]


# ------------------------------------------------------------------ mixing
def brute_targets(sizes, weights, epochs):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        words = total - epochs * sum(sizes[s] for s in capped)
        share = sum(w[s] for s in free)
        more = {s for s in free if w[s] * words > epochs * sizes[s] * share}
        if not more:
            return {s: epochs * sizes[s] if s in capped else w[s] * words / share for s in names}
        capped |= more


def test_mixing(spark):
    from sward.llm.mixing import mix, mixed_texts
    rng = random.Random(2)
    docs = []
    for i in range(600):
        source = "hot" if i % 3 else rng.choice(["a", "b", "ü", None, "tiny"] if i % 50 else ["rare"])
        docs.append((i, "  ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(30))) + "\n", source))
    docs += [(1000, "one two " * 5000, "rare"), (1001, None, "empty"), (1002, " \t", "empty"), (None, "no id", "a"), (5, "twice", "a"), (5, "twice", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "taken": F.lit(1), "one": F.lit(2)})
    got = mix(spark, df.repartition(6)).collect()
    assert len(got) == len(docs)
    again = mix(spark, df.repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes, (5, 2, 1), 3)
    taken = {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    copies = mixed_texts(spark, df).collect()
    assert sum(len(r["text"].split()) for r in copies) == sum(taken.values())
    by_doc = {}
    for r in copies:
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + len(r["text"].split())
    assert all(by_doc.get(r["doc_id"], 0) == r["taken"] for r in got if r["doc_id"] not in (5, None))


def test_mixing_edges(spark):
    from sward.llm.mixing import mix, word_counts
    schema = "doc_id long, text string, source string"
    assert mix(spark, spark.createDataFrame([], schema)).collect() == []
    got = mix(spark, spark.createDataFrame([(1, None, None), (2, "", "a")], schema)).collect()
    assert sorted((r["doc_id"], r["target"], r["taken"]) for r in got) == [(1, 0.0, 0), (2, 0.0, 0)]
    one = mix(spark, spark.createDataFrame([(1, "x y", None)], schema)).collect()[0]
    assert (one["target"], one["taken"]) == (2.0, 2)
    import sward.llm.mixing as M
    texts = ["a b", None, "", "c", "d  e\tf ", " ", "g", "hh ii"] * 3
    whole = M.PIECE
    try:
        for piece in (1, 2, 3, 5, 1 << 20):
            M.PIECE = piece
            assert word_counts(pa.array(texts)).tolist() == [len((t or "").split()) for t in texts]
    finally:
        M.PIECE = whole
