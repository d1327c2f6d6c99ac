"""Edge cases and brute-force checks of the training-data operators on small tables."""
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (4, "one", "b"), (5, LONG, "a"),
       (6, LONG + " tail", "a"), (None, "no id at all", "a"), (7, "Ünï çode ☃ \0 x", None), (8, "!!! ???", "b")]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    # extra columns under names that the operators use themselves
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"set_id": F.lit(1), "label": F.lit("x"), "rows": F.lit(2), "h": F.lit(0),
                                                           "n_chars": F.length("text").cast("long")})


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


def words(t):
    return (t or "").encode().lower().split()


def brute_components(docs, k, pct):
    sets = {}
    for d, t in docs:
        w = words(t)
        sets[d] = {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= pct * len(s | t):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_minhash_chain_of_near_copies(spark):
    from sward.llm.minhash import near_duplicates
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    docs, text = [], list(base)
    for i in range(40):  # each a little further from the first, so the ends are not similar
        docs.append((100 - i, " ".join(text)))
        text[rng.randrange(len(text))] = f"x{i}"
    docs += [(200 + i, " ".join(f"q{rng.randrange(50)}" for _ in range(60))) for i in range(30)]
    got = {r[0]: (r[1], r[2]) for r in near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"),
                                                       shingle_words=2, threshold=0.8).collect()}
    assert got == brute_components(docs, 2, 80)


def test_minhash_edges(spark, odd):
    from sward.llm.minhash import drop_near_duplicates, near_duplicates
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(spark, odd).collect()), key=str)
    assert (1, 0, 1, True) in got and (3, 0, 3, True) in got and got.count((4, 1, 4, True)) == 2
    assert (6, 978, 5, False) in got and any(g[0] is None and g[3] for g in got) and len(got) == len(ODD)
    assert drop_near_duplicates(spark, odd).count() == len(ODD) - 1
    assert near_duplicates(spark, empty(spark)).count() == 0


def test_components(spark):
    from sward.llm.common import Scratch
    from sward.llm.neardup import components
    path = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 102), (102, 101), (7, 7), (9, None)]
    got = dict(map(tuple, components(Scratch(spark, "t"), spark.createDataFrame(path, "u long, v long"), 2).collect()))
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100, 103: 100}


def test_decontamination(spark, odd):
    from sward.llm.decontam import drop_leaks, leaks
    item = [f"Bench{i}" for i in range(30)]
    sub = item[:]
    sub[11] = sub[17] = "other"
    filler = " ".join(f"f{i}" for i in range(200))
    docs = [(1, filler + " " + ", ".join(item) + "! " + filler), (2, " ".join(sub).upper()), (3, filler), (4, " ".join(item[:8])),
            (5, " ".join(item[10:]) + " " + filler), (5, " ".join(item[10:]) + " " + filler), (None, " ".join(item))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item) + "."), (8, "too short"), (9, None), (7, " ".join(item) + ".")], "item_id long, text string")
    for rows in (500_000, 0):  # broadcast and shuffled test seeds
        got = sorted(tuple(r) for r in leaks(spark, df, bench, broadcast_rows=rows).collect())
        assert got == [(1, 7, 200, 0, 30, 30, 13), (2, 7, 0, 0, 30, 28, 12), (5, 7, 0, 10, 20, 20, 13)]
    assert sorted(str(r[0]) for r in drop_leaks(spark, df, bench).collect()) == ["3", "4", "None"]
    assert drop_leaks(spark, odd, bench).count() == len(ODD)
    assert leaks(spark, odd, bench.limit(0)).count() == 0 and leaks(spark, empty(spark), bench).count() == 0


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    from sward.llm.packing import pack_documents
    from sward.llm.queries import tokenizer_path
    tok = Tokenizer.from_file(tokenizer_path())
    more = [(20, "It's <|endoftext|> Don't. STOP,now... a.b, É.È. İx 12.5 x y"), (21, "a," * 40), (22, "<|ENDOFTEXT|> KK")]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = pack_documents(df, tokenizer_path(), block_pieces=20).collect()
    want = {}
    for d, t in [(r[0], r[1]) for r in ODD] + more:
        want[d] = tok.encode(t or "", add_special_tokens=False).ids + [2]
    seen, seq = {}, {}
    for r in rows:
        ids = want[r["doc_id"]]
        piece = np.array(ids[r["start"]:r["start"] + r["length"]], dtype="<u4")
        assert r["doc_tokens"] == len(ids) and r["length"] == len(piece) > 0 and r["ids_crc32"] == zlib.crc32(piece.tobytes())
        seen.setdefault(r["doc_id"], []).extend(range(r["start"], r["start"] + r["length"]))
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, ids in want.items():
        assert sorted(seen[d]) == sorted(list(range(len(ids))) * (2 if d == 4 else 1))
    for s in seq.values():
        at = 0
        for off, size in sorted(s):
            assert off == at
            at += size
        assert at <= 4096
    assert pack_documents(empty(spark), tokenizer_path()).count() == 0


def test_topk(spark):
    from sward.llm.topk import top_k
    rng = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(700)]
    vecs += [(700 + i, vecs[5][1]) for i in range(60)]  # ties
    vecs += [(1000, None), (None, vecs[0][1]), (1100, [float("nan")] * 8), (1200, [None] * 8), (1300, [float("inf")] * 8)]
    df = spark.createDataFrame(vecs + vecs[:3], "vec_id long, embedding array<float>").withColumn("q", F.lit(0))
    got = [tuple(r) for r in top_k(spark, df, F.col("vec_id") % 100 == 0, shard_rows=100, block_queries=3).orderBy("query_id", "rank").collect()]
    pts = {i: np.floor(1024 * np.asarray(v, np.float32).astype(np.float64)).astype(np.int64) for i, v in vecs[:760]}
    want = []
    for q in range(0, 760, 100):
        best = sorted(((-int(pts[q] @ v), i) for i, v in pts.items() if i != q))[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want
    assert top_k(spark, df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    huge = spark.createDataFrame([(0, [3e5, 0.0]), (1, [3e5, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(spark, huge, F.col("vec_id") == 0).orderBy("rank").collect()] == \
        [(0, 1, 1, (1024 * 300000) ** 2), (0, 2, 2, 0)]


def test_warc(spark):
    from sward.llm.warc import decode_record, digest, encode_record, frames, round_trip
    pages = [(1, "u", "<p>a</p>" * 50), (2, None, None), (3, "u", ""), (5, "http://x/\r\ny", "<p>a</p>" * 50), (4, "u", "é"),
             (5, "http://x/\r\ny", "<p>a</p>" * 50), (None, "u", "é"), (9, "v", "z" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    got = sorted((tuple(r) for r in round_trip(spark, df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for p, _, h in pages:
        b = (h or "").encode()
        same = [q for q, _, g in pages if q is not None and (g or "").encode() == b]
        ref = min(same) if p is not None and min(same) != p else None
        want.append((p, len(b), digest(b), "response" if ref is None else "revisit", ref))
    assert got == sorted(want, key=str)
    assert round_trip(spark, df.limit(0)).count() == 0
    raw = encode_record(1, "u", b"abc", None, digest(b"abc"))
    assert decode_record(raw)["block"] == b"abc"
    for bad in (raw[:-1], raw.replace(b"abc", b"abd"), raw.replace(b"WARC/1.1", b"HTTP/1.1"), raw.replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            decode_record(bad)
    import zstandard
    data = zstandard.ZstdCompressor().compress(raw)
    assert [x[2] for x in frames(data * 2)[1]] == [raw, raw]
    with pytest.raises(ValueError):
        list(frames(data[:-3])[1])


def held(docs):
    return [d for d in docs if zlib.crc32(str(d).encode()) % 3 == 1]


def test_quality(spark, odd):
    from sward.llm.quality import forward_backward, keep_good, score_quality
    rng = random.Random(5)
    docs, labels = [], []
    for d in range(300):
        lines = [" ".join(f"word{rng.randrange(90)}" for _ in range(rng.randrange(4, 20))) + "." for _ in range(rng.randrange(1, 6))]
        if d % 4 == 0:
            lines = [" ".join(w + "@#" for w in x.split()) if i else x for i, x in enumerate(lines + lines)]
        docs.append((d, "\n".join(lines)))
        labels.append((d, int(d % 4 != 0), 0))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in score_quality(spark, df, lab).collect()}
    test = held(range(300))
    assert all(got[d]["held_out"] for d in test) and sum(got[d]["predicted"] == int(d % 4 != 0) for d in test) >= 0.97 * len(test)
    assert keep_good(spark, df, lab).count() == sum(r["predicted"] for r in got.values())
    out = score_quality(spark, odd, lab).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in score_quality(spark, odd, lab.limit(0)).collect()} == {0.5}
    assert score_quality(spark, empty(spark), lab).count() == 0
    kept = keep_good(spark, odd, lab)
    assert kept.columns == odd.columns
    # marginals of a chain against enumeration of all labelings
    rng = np.random.default_rng(0)
    score, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    off = np.array([0, 4, 4, 7])
    good, _, log_z = forward_backward(score, trans, off)
    for a, b in ((0, 4), (4, 7)):
        weight = {}
        for y in np.ndindex(*[2] * (b - a)):
            weight[y] = np.exp(sum(score[a + i] * y[i] for i in range(b - a)) + sum(trans[y[i], y[i + 1]] for i in range(b - a - 1)))
        z = sum(weight.values())
        for i in range(b - a):
            assert good[a + i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / z)


def test_language(spark, odd):
    from sward.llm.langid import predict_language
    rng = random.Random(2)
    voc = {"aa": ["kato", "mine", "solu", "taka"], "bb": ["ström", "blick", "wurz", "quad"], "cc": ["жили", "были", "дом", "сад"]}
    docs = [(d, " ".join(rng.choice(voc[x]) for _ in range(12)), x) for d, x in enumerate("aa bb cc".split() * 60)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = {r["doc_id"]: r for r in predict_language(spark, df).collect()}
    assert all(got[d]["lang_pred"] == x for d, _, x in docs) and sum(r["held_out"] for r in got.values()) == len(held(range(180)))
    out = predict_language(spark, df.unionByName(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))).collect()
    und = [r["score"] for r in out if r["lang_pred"] == "und"]
    assert len(out) == 180 + len(ODD) and len(und) == 4 and set(und) == {0.0}
    assert all(0 <= r["score"] <= 1 for r in out)
    assert predict_language(spark, empty(spark)).count() == 0
    assert {r["lang_pred"] for r in predict_language(spark, df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_automaton_matches_edit_distance():
    from sward.llm.toxicity import Automaton
    rng = random.Random(4)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 7))): rng.randrange(3) for _ in range(25)}
    auto = Automaton(terms)
    for _ in range(3000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 8)))
        near = [(distance(w, t), t) for t, k in terms.items() if distance(w, t) <= k]
        assert auto.match(w) == (min(near) if near else None)
    assert Automaton({}).match("x") is None


def test_toxicity(spark, odd):
    from sward.llm.toxicity import score_toxicity
    rng = random.Random(6)
    docs, labels = [], []
    for d in range(400):
        w = [f"n{rng.randrange(300)}ab" for _ in range(40)]
        if d % 5 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["vilespit", "grubface", "Muckhead!"])
        docs.append((d, " ".join(w)))
        labels.append((d, 1, int(d % 5 == 0)))
    test = held(range(400))
    fuzzy = next(d for d in test if d % 5)
    docs[fuzzy] = (fuzzy, "n1ab vilespitt n2ab grubfacce n3ab mukhead n4ab")
    got = {r["doc_id"]: r for r in score_toxicity(spark, spark.createDataFrame(docs, "doc_id long, text string"),
                                                  spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[d]["predicted"] == int(d % 5 == 0) for d in test if d != fuzzy)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = score_toxicity(spark, odd, lab).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in score_toxicity(spark, odd, lab.limit(0)).collect()} == {0.0}
    assert score_toxicity(spark, empty(spark), lab).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_link_finds_every_linked_bucket_mate(spark, seed):
    """One bucket of loose copies around two centres: the hub is unlike many classes, links among these are kept."""
    import random
    from sward.llm.common import Scratch
    from sward.llm.neardup import link
    rng = random.Random(seed)
    centre = list(range(100))
    other = centre[:72] + list(range(200, 228))
    sets = []
    for i in range(70):
        base = list(other if i % 3 == 0 else centre)
        for at in rng.sample(range(100), rng.choice([2, 6, 10, 13])):
            base[at] = rng.randrange(1000, 1200)
        sets.append(set(base[:rng.choice([100, 100, 92])]))
    names = [bytes([i]) for i in range(len(sets))]
    got = link(Scratch(spark, "t"), spark.createDataFrame([(1, n) for n in names], "key long, set_id binary"),
               spark.createDataFrame([(n, len(s), sorted(s)) for n, s in zip(names, sets)],
                                     "set_id binary, n long, s array<long>"), 0.8)
    got = {bytes(r["set_id"]): bytes(r["comp"]) for r in got.collect()}
    low = {n: n for n in names}
    for _ in names:
        for n, s in zip(names, sets):
            for m, t in zip(names, sets):
                if len(s & t) * 100 >= len(s | t) * 80:
                    low[n] = low[m] = min(low[n], low[m])
    assert {n: got.get(n, n) for n in names} == low
    assert len(set(low.values())) > 2
