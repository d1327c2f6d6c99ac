"""Every pair of paragraphs at the threshold links, short ones too."""
import random

import numpy as np
import pytest
import test_paragraphs

from sward.llm import paragraphs as P


@pytest.mark.parametrize("seed", [1, 2])
def test_short_paragraphs_that_differ_by_a_word_at_their_edge(spark, monkeypatch, seed):
    monkeypatch.setattr(test_paragraphs, "NEAR_SHINGLES", 1)
    rng = random.Random(seed)
    docs = []
    for d in range(0, 80, 2):
        part = [f"p{rng.randrange(10**6)}" for _ in range(rng.randrange(12, 45))]
        docs += [(d, " ".join(part)), (d + 1, " ".join(part + [f"tail{d}"] * rng.randrange(1, 3)))]
    want = test_paragraphs.brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = P.repeated_paragraphs(spark, df).collect()
    text = dict(docs)
    assert {(r["doc_id"], text[r["doc_id"]], r["para"]): r["span_words"] for r in got} == {k: v[1] for k, v in want.items()}
    monkeypatch.setattr(test_paragraphs, "NEAR_SHINGLES", 16)
    assert len(test_paragraphs.brute(docs)) < len(want)  # what links by equal sets only


@pytest.mark.parametrize("pct", [50, 80, 95])
def test_sketches_of_similar_sets_meet(pct):
    rng = np.random.default_rng(pct)
    close = 0
    for _ in range(4000):
        n = int(rng.integers(1, 61))
        a = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(n) > rng.random() / 3], rng.integers(1, 1 << 62, int(rng.integers(0, n // 4 + 2))).astype(np.uint64)]))
        inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if inter * 100 >= pct * union and inter < union:
            close += 1
            p, q = P.sketch_sizes(np.array([len(a), len(b)]), pct).tolist()
            assert np.intersect1d(a[:p], b[:q]).size
    assert close > 30


def test_frequent_shingles_are_the_largest():
    s, at = np.array([2, 5, 9, 1, 5, 7, 8], np.uint64), np.array([0, 3, 3 + 4])
    moved = P.frequent_last(s, at, (np.array([1, 5], np.uint64), np.array([1, 2])))
    assert moved.tolist() == [2, 9, 5, 7, 8, 1, 5] and s.tolist() == [2, 5, 9, 1, 5, 7, 8]


def test_recall_below_one_uses_bands(spark):
    docs = [(d, " ".join([*(f"own{d}x{i}" for i in range(40)), *(f"w{i}" for i in range(60))])) for d in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    some = {tuple(r) for r in P.repeated_paragraphs(spark, df, recall=0.9, near_shingles=16).collect()}
    assert some and some <= {tuple(r) for r in P.repeated_paragraphs(spark, df).collect()}
