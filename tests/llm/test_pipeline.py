"""The pipeline's stages against plain Python, each on what its predecessor kept, and on an odd table."""
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from test_operators import LONG, brute_components
from test_paragraphs import brute, units

SF = "/root/testdata/sf0.001"


def plain_cuts(docs):
    """Texts after substring dedup; paragraphs and components from the brute-force version."""
    found = brute(docs)
    keep = {}
    for (d, t, i), (comp, _) in found.items():
        keep.setdefault(comp, []).append((d, t, i))
    ends = {}
    for key, (comp, _) in found.items():
        if key != min(keep[comp], key=lambda k: (k[0], k[2])):
            ends.setdefault(key[:2], []).append(key[2])
    out = {}
    for d, t in docs:
        text = t
        if (d, t) in ends:
            spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0d]+", t)]
            gone = [(spans[a][0], spans[a + len(w) - 1][1]) for i, w, a in units(t) if i in ends[(d, t)]]
            text, at = "", 0
            for a, b in sorted(gone):
                text, at = text + t[at:a], b
            text += t[at:]
        out[d] = text
    return out


def plain_leak(doc, item, need=13, share=0.8):
    """Whether some alignment has a window of 13 tokens (the item, if shorter) of which 0.8 are equal."""
    def tokens(x):
        return [w for w in re.split(r"[^\w]+|_", (x or "").lower()) if w]
    a, b = tokens(doc), tokens(item)
    if not a or not b:
        return False
    w = min(need, len(b))
    names = {x: i for i, x in enumerate(dict.fromkeys(a + b))}
    eq = (np.array([names[x] for x in a])[:, None] == np.array([names[x] for x in b])[None, :]).astype(int)
    least = math.ceil(w * share)
    for shift in range(-len(b) + w, len(a) - w + 1):
        d = np.diagonal(eq, -shift)
        if len(d) >= w and np.convolve(d, np.ones(w, int), "valid").max() >= least:
            return True
    return False


def test_stages_against_plain_python(spark):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    from sward.llm.queries import tokenizer_path
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontaminate", "packing"] and P.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = P.quality(spark, docs, SF).cache()
    assert good.columns == docs.columns and 0.5 * docs.count() < good.count() < docs.count()
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    comp = brute_components(list(texts.items()), 5, 80)
    kept = {d: t for d, t in texts.items() if comp[d][0] == 0 or comp[d][1] == d}
    near = P.near_dedup(spark, good, SF).cache()
    assert {r["doc_id"]: r["text"] for r in near.collect()} == kept
    cut = P.substring_dedup(spark, near, SF).cache()
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    want = plain_cuts(sorted(kept.items()))
    assert got == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["text"] != kept[r["doc_id"]])
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in P.decontaminate(spark, cut, SF).collect()}
    assert left == {d for d, t in want.items() if not any(plain_leak(t, i) for i in items)}
    tok = Tokenizer.from_file(tokenizer_path())
    seen, fill = {}, {}
    for r in P.run(spark, SF).collect():
        seen.setdefault(r["doc_id"], []).append(r)
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert set(seen) == left and max(fill.values()) <= 4096
    for d, pieces in seen.items():
        ids = np.array(tok.encode(want[d] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        pieces.sort(key=lambda r: r["start"])
        assert [p["start"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist() and sum(p["length"] for p in pieces) == len(ids)
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"]:p["start"] + p["length"]].tobytes()) and p["doc_tokens"] == len(ids)


def test_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as P
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, LONG), (6, LONG + " tail"), (None, "no id at all"), (7, "Ünï ☃ \0 x")]
    for name, data in (("odd", rows), ("none", [])):
        d = str(tmp_path / name)
        df = spark.createDataFrame(data, "doc_id long, text string").withColumns(
            {"lang": F.lit("a"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema]).withColumns({c: F.lit(1) for c in ("th", "row", "cuts", "class", "h")})
        df.write.parquet(f"{d}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, d)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        packed = P.run(spark, d).collect()
        assert (len(packed) > 0) == bool(data)
