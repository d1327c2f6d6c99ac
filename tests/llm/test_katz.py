"""Katz model against a brute-force version in plain Python."""
import math
import zlib
from collections import Counter

import pytest

from sward.llm.katz import good_turing, score_documents

K = 5


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["</s>"]


def brute(docs):
    train = [(d, t) for d, t in docs if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    uni, bi, hist = Counter(), Counter(), Counter()
    for _, t in train:
        ws = words(t)
        uni.update(ws)
        for h, w in zip(["<s>"] + ws, ws):
            bi[h, w] += 1
            hist[h] += 1
    n, v = sum(uni.values()), len(uni)
    cc = Counter(uni.values())
    d1 = good_turing([0] + [cc[r] for r in range(1, K + 2)])
    e = 1 / (n + v + 1)
    p1 = {w: (1 - e) * (d1[c] if c <= K else 1) * c / n for w, c in uni.items()}
    unknown = 1 - sum(p1.values()) if n else 1.0
    cc = Counter(bi.values())
    d2 = good_turing([0] + [cc[r] for r in range(1, K + 2)])
    seen = {hw: (d2[c] if c <= K else 1) * c / (hist[hw[0]] + 1) for hw, c in bi.items() if c >= 2}
    alpha, after = {}, {h: [] for h in hist}
    for h, w in seen:
        after[h].append(w)
    for h, a in after.items():
        alpha[h] = (1 - sum(seen[h, w] for w in a)) / (1 - sum(p1[w] for w in a))

    def prob(h, w):
        if (h, w) in seen:
            return seen[h, w]
        return alpha.get(h, 1.0) * p1.get(w, unknown)

    for h in sorted(hist)[:20]:  # exactly normalised
        assert math.isclose(sum(prob(h, w) for w in uni) + prob(h, "\0new"), 1, rel_tol=1e-9)
    out = []
    for d, t in docs:
        ws = words(t)
        out.append((d, len(ws), sum(w in uni for w in ws), n,
                    sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws),
                    sum(math.log10(prob(h, w)) for h, w in zip(["<s>"] + ws, ws))))
    return out


def compare(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").drop("lang") if docs and len(docs[0]) == 3 \
        else spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, score_documents(spark, df.repartition(3), least=2).drop("held_out").collect()), key=str)
    want = sorted(brute(docs), key=str)
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[5])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


def test_matches_brute_force_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    compare(spark, [(r[0], r[1]) for r in rows])


def test_edge_cases(spark, monkeypatch):
    import sward.llm.katz as katz
    monkeypatch.setattr(katz, "HOT", 3)  # most words go the way of rare ones
    long = "a b " * 3000
    compare(spark, [(1, None), (2, ""), (3, "a b a b"), (3, "a b a b"), (4, long), (5, "A\tb\x0bc"), (9, "zz zz new"),
                    (None, "a b unseen"), (7, " \n ")])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert score_documents(spark, df).collect() == []


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    out = score_documents(spark, spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in out] == [(held, True, 3, 0, 0, 0.0, 0.0)]
