"""A long text has the paragraphs that it would have looked at whole; none is lost where its pieces meet."""
import random

import numpy as np
import pyarrow as pa
import pytest

from sward.llm import common as C
from sward.llm import paragraphs as P
from test_paragraphs import units


def found(text):
    """Paragraphs of a text as ``_fingerprints`` gives them, without the keys."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 0, 0]), pa.array(["one text before it", text, "and a short one of some words behind it"])],
                                       ["doc_id", "th", "text"])
    rows = [r for b in P._fingerprints(5, 4, 1, 1)([batch]) for r in zip(*(b.column(c).to_pylist() for c in b.schema.names))]
    return [r[2:] for r in rows if r[0] == 2], len(rows)


@pytest.mark.parametrize("seed", range(8))
def test_pieces_give_the_paragraphs_of_the_whole_text(monkeypatch, seed):
    rng = random.Random(seed)
    words = []
    while len(words) < 2500:
        words += rng.choice([["Der"] * rng.randrange(3, 300), ["x" * rng.randrange(1, 5000)] * rng.choice([1, 7])] + 30 * [[f"wörd{rng.randrange(600)}" for _ in range(20)]])
    text = "".join(w + rng.choice([" ", "\n", " \t", " " * rng.choice([1, 1, 1, 6000])]) for w in words)
    whole = found(text)
    assert [(r[0], r[3]) for r in whole[0]] == [(i, len(w)) for i, w, _ in units(text)]
    monkeypatch.setattr(P, "SLICE_BYTES", rng.choice([200, 1000, 4096]))
    assert found(text) == whole
    for r in whole[0]:
        assert len(text[r[1]:r[2]].split()) == r[3]


def test_passage_where_two_pieces_meet(spark):
    def prose(name, n):
        return [f"{name}{i}" for i in range(n)]
    passage, around = prose("p", 60), (prose("left", 80), prose("right", 80))
    head, at = [], 0
    room = P.SLICE_BYTES - len(" ".join(around[0] + passage[:30]))
    while at < room:  # the first piece ends inside the passage
        head.append(f"head{len(head)}")
        at += len(head[-1]) + 1
    short = " ".join([*around[0], *passage, *around[1]])
    long = " ".join(head) + " " + short + " " + " ".join(prose("tail", 140_000))
    assert len(long) > 2 * P.SLICE_BYTES and long.index("p0 ") < P.SLICE_BYTES < long.index("p59 ")
    other = " ".join([*prose("x", 90), *passage, *prose("y", 90)])

    def rows(text):
        df = spark.createDataFrame([(1, other), (2, text)], "doc_id long, text string")
        cut = dict(map(tuple, P.drop_repeated_paragraphs(spark, df).collect()))
        assert cut[1] == other
        texts = {1: other, 2: text}
        return sorted((r["doc_id"], texts[r["doc_id"]][r["start"]:r["end"]], r["span_words"], r["removed"]) for r in P.repeated_paragraphs(spark, df).collect()), len(text) - len(cut[2])

    want = rows(short)
    assert sum(len(r[1].split()) for r in want[0] if r[3]) >= P.MIN_WORDS and want[1] > 100
    assert rows(long) == want


@pytest.mark.parametrize("n", range(7))
def test_texts_of_few_words(n):
    """Alone in a slice, or in the pieces of a text whose words are very long."""
    h = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s, at = C.shingle_sets(h, np.array([0, n]), 5)
    assert at.tolist() == [0, len(s)] and s.tolist() == C.shingle_hashes(h, 5).tolist()
