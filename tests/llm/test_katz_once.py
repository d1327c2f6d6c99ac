"""The registered Katz query keeps pairs seen once, with the Good-Turing ratio d(1)."""
import math
import zlib
from collections import Counter

import pytest

from sward.llm.katz import good_turing, score_documents

SF = "/root/testdata/sf0.001"
K = 5


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["</s>"]


def brute(docs):
    """Score per document with every training pair in the model."""
    train = [words(t) for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2]
    uni = Counter(w for ws in train for w in ws)
    bi = Counter(hw for ws in train for hw in zip(["<s>"] + ws, ws))
    hist = uni + Counter({"<s>": len(train)})
    n, v = sum(uni.values()), len(uni)
    cc, cc2 = Counter(uni.values()), Counter(bi.values())
    d1, d2 = (good_turing([0] + [x[r] for r in range(1, K + 2)]) for x in (cc, cc2))
    e = 1 / (n + v + 1)
    p1 = {w: (1 - e) * d1[min(c, K + 1)] * c / n for w, c in uni.items()}
    seen = {(h, w): d2[min(c, K + 1)] * c / (hist[h] + 1) for (h, w), c in bi.items()}
    left, left1 = Counter(), Counter()
    for (h, w), p in seen.items():
        left[h] += p
        left1[h] += p1[w]
    unknown = 1 - sum(p1.values())

    def prob(h, w):
        return seen[h, w] if (h, w) in seen else (1 - left[h]) / (1 - left1[h]) * p1.get(w, unknown)

    return {d: sum(math.log10(prob(h, w)) for h, w in zip(["<s>"] + words(t), words(t))) for d, t in docs}


def test_query_keeps_pairs_seen_once(spark):
    from sward.llm.queries import QUERIES
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["score"] for r in QUERIES["op7_katz"](spark, SF).collect()}
    assert got == pytest.approx(brute(docs), rel=1e-9)


def test_pairs_seen_once_of_rare_words(spark, monkeypatch):
    import sward.llm.katz as katz
    monkeypatch.setattr(katz, "HOT", 40)  # most words go the way of rare ones
    monkeypatch.setattr(katz, "PARTITION_TOKENS", 5000)
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["score"] for r in score_documents(spark, df, least=1).collect()}
    assert got == pytest.approx(brute([tuple(r) for r in df.collect()]), rel=1e-9)
