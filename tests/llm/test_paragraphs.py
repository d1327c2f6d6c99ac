"""Repeated passages against brute force, and the edges of the operator."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sward.llm import common as C
from sward.llm.paragraphs import MIN_WORDS, NEAR_SHINGLES, cut_points, drop_repeated_paragraphs, repeated_paragraphs, tune_bands

SCHEMA = "doc_id long, text string"


def units(text, k=5):
    """(number, words, first word) of the paragraphs of a text; the cuts are the operator's, the rest is plain Python."""
    data, off = C.string_buffers(pa.array([text]))
    h, row, _, _ = C.word_hashes(data, off)
    if not len(h):
        return []
    at = [*cut_points(h, row).tolist(), len(h)]
    w = text.lower().split()
    assert len(w) == len(h)
    return [(i, w[a:b], a) for i, (a, b) in enumerate(zip(at, at[1:])) if b - a >= k]


def brute(docs, min_words=MIN_WORDS, k=5):
    occ = []  # (doc, text, number, shingles, words)
    for d, t in dict.fromkeys(docs):
        if d is not None and t:
            occ += [(d, t, i, frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)), len(w)) for i, w, _ in units(t)]
    classes = sorted({o[3] for o in occ}, key=sorted)
    comp = {c: i for i, c in enumerate(classes)}
    for a in classes:
        for b in classes:
            if comp[a] != comp[b] and min(len(a), len(b)) >= NEAR_SHINGLES and len(a & b) * 100 >= 80 * len(a | b):
                low, high = sorted((comp[a], comp[b]))
                comp = {c: low if x == high else x for c, x in comp.items()}
    docs_of = {}
    for o in occ:
        docs_of.setdefault(comp[o[3]], set()).add(o[0])
    hits = sorted({(o[0], o[1], o[2], comp[o[3]], o[4]) for o in occ if len(docs_of[comp[o[3]]]) > 1})
    spans, last = [], None
    for o in hits:
        if last is None or o[:2] != last[:2] or o[2] - last[2] > 2:
            spans.append([])
        spans[-1].append(o)
        last = o
    found = [(o, sum(x[4] for x in s)) for s in spans if sum(x[4] for x in s) >= min_words for o in s]
    ids = {}
    for o, _ in found:
        ids.setdefault(o[3], set()).add(o[0])
    return {(o[0], o[1], o[2]): (o[3], words) for o, words in found if len(ids[o[3]]) > 1}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    shared = [prose(rng.choice([12, 30, 55, 80, 120])) for _ in range(6)]
    docs = []
    for d in range(60):
        text = prose(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            part = list(rng.choice(shared))
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "edit"
            if rng.random() < 0.4:
                part = ["again"] * 3 + part[rng.randrange(3):]
            text += part + prose(rng.randrange(40))
        if d % 9 == 0:
            text += ["Again"] * rng.randrange(3, 90)
        docs.append((d, "".join(w + rng.choice([" ", " ", "\n", " \t"]) for w in text)))
    docs += [docs[3], (4, docs[5][1]), (None, docs[6][1]), (70, None), (71, ""), (72, " \n")]
    df = spark.createDataFrame(docs, SCHEMA).withColumns({c: F.lit(1) for c in ("th", "para", "class", "comp", "start", "row")}).repartition(5)
    want = brute(docs)
    texts = {}
    for d, t in docs:
        texts.setdefault(d, []).append(t)
    th = dict(spark.createDataFrame(sorted({t for _, t in docs if t}), "string").toDF("t").select(F.xxhash64("t"), "t").collect())
    got = repeated_paragraphs(spark, df).collect()
    assert {(r["doc_id"], th[r["th"]], r["para"]): r["span_words"] for r in got} == {k: v[1] for k, v in want.items()}
    assert len(got) == len(want) > 20
    keepers = {}
    for r in got:
        key = (r["doc_id"], th[r["th"]], r["para"])
        keepers.setdefault((r["cluster_doc_id"], r["cluster_para"], want[key][0]), set()).add(want[key][0])
        part = th[r["th"]][r["start"]:r["end"]]
        assert part.lower().split() == next(w for i, w, _ in units(th[r["th"]]) if i == r["para"]) and len(part.split()) == r["n_words"]
    assert len({k[2] for k in keepers}) == len(keepers)  # one occurrence stays of each component
    assert sum(not r["removed"] for r in got) == len(keepers)


def test_passages_across_lines_and_inside_lines(spark):
    para = [f"p{i}" for i in range(51)]
    own = [" ".join(f"d{d}w{i}" for i in range(60)) for d in range(6)]
    wrapped = "\n".join(" ".join(para[i:i + 7]) for i in range(0, 51, 7))  # lines of fewer than ten words
    boiler = "All rights reserved under the licence named above here."
    docs = [(1, own[0] + " " + " ".join(para) + " " + own[1]), (2, own[2] + "\n" + wrapped + "\n" + own[3]),
            (3, own[4] + "\n" + boiler), (4, boiler + "\n" + own[5])]
    df = spark.createDataFrame(docs, SCHEMA)
    got = repeated_paragraphs(spark, df).collect()
    assert {r["doc_id"] for r in got} == {1, 2} and all(r["span_words"] >= 25 for r in got)
    cut = dict(map(tuple, drop_repeated_paragraphs(spark, df).collect()))
    assert cut[1] == docs[0][1] and cut[3] == docs[2][1] and cut[4] == docs[3][1]
    left = cut[2].split()
    assert own[2].split() == left[:60] and own[3].split() == left[-60:] and len(left) <= 120 + 26


def test_a_cut_belongs_to_its_own_text(spark):
    """Rows (1, P), (2, P), (2, U): the unique text U loses nothing."""
    p, u = " ".join(f"p{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    df = spark.createDataFrame([(1, p, 9), (2, p, 9), (2, u, 9), (None, p, 9), (5, None, None)], "doc_id long, text string, n_chars int").withColumns(
        {"_gone": F.lit("x"), "_doc": F.lit(1), "cuts": F.lit(2), "th": F.lit(3)})
    out = drop_repeated_paragraphs(spark, df)
    assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    got = sorted(((r["doc_id"], r["text"] if r["text"] is None else r["text"].strip(), r["n_chars"]) for r in out.collect()), key=str)
    assert (1, p, 9) in got and (2, u, 9) in got and (None, p, 9) in got and (5, None, None) in got
    assert [g for g in got if g[0] == 2 and g[1] != u][0][1:] == ("", 2) or len([g for g in got if g[0] == 2 and g[1] != u][0][1]) < 40


def test_said_again_and_again(spark):
    """A word repeated on and on is one paragraph, whatever the number."""
    docs = [(1, "Der " * 300), (2, "Intro of the other kind here. " + "Der " * 90 + "tail"), (3, "Das " * 40)]
    got = repeated_paragraphs(spark, spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r["doc_id"] for r in got} == {1, 2}


def test_long_texts_in_pieces(spark, monkeypatch):
    import sward.llm.paragraphs as P
    rng = random.Random(5)
    words = [f"wörd{rng.randrange(5000)}" for _ in range(3000)]
    text = " ".join(words)
    monkeypatch.setattr(P, "SLICE_BYTES", 4096)
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([1]), pa.array([text])], ["doc_id", "th", "text"])
    seen, at = [], 0
    for ids, th, chars, para, piece in P._pieces([batch]):
        part = piece[0].as_py().decode()
        assert text[int(chars[0]):int(chars[0]) + len(part)] == part and len(part.encode()) <= 4096 + 20
        seen += part.split()
        at += 1
    assert seen == words and at > 5
    batches = list(P._fingerprints(5, 2, 1, 16)([batch]))
    for b in batches:
        for start, end, n in zip(*(b.column(c).to_pylist() for c in ("start", "end", "n_words"))):
            assert len(text[start:end].split()) == n and text[start:end] == text[start:end].strip()
    paras = [p for b in batches for p in b.column("para").to_pylist()]
    assert len(set(paras)) == len(paras)


def test_edges(spark):
    assert repeated_paragraphs(spark, spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b c"), (3, "same words " * 60), (3, "same words " * 60)], SCHEMA)
    assert repeated_paragraphs(spark, df).collect() == [] and drop_repeated_paragraphs(spark, df).count() == 5
    bands, rows = tune_bands(0.8, 0.999)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.999


def test_cuts_follow_the_words_around_them():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 1 << 60, 4000).astype(np.uint64)
    whole = set(cut_points(h, np.zeros(4000, np.int64)).tolist())
    part = set((cut_points(h[1000:3000], np.zeros(2000, np.int64)) + 1000).tolist())
    assert {x for x in whole if 1070 < x < 2930} == {x for x in part if 1070 < x < 2930}
    size = np.diff(sorted(whole))
    assert size.max() <= 64 and 12 < size.mean() < 22
    two = np.concatenate([h[:50], h[:50]])
    rows = np.repeat([0, 1], 50)
    cut = cut_points(two, rows).tolist()
    assert [c for c in cut if c < 50] == [c - 50 for c in cut if c >= 50]
