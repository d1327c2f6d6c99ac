"""Language identification with bit-sliced Bloom filters of character n-grams.

One Bloom filter per language, stored slice by slice: row r of the table holds
bit r of every language's filter, so ANDing the rows of an n-gram's hash
positions gives the mask of all languages that contain it.  A text's n-grams are
looked up, hits are counted per language (popcounts per bit), the counts are
corrected for the filters' false positives, and the largest decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sward.llm import common as C
from sward.llm.models import HELD_OUT, SPLIT, held_out

GRAM = 4
#: Filters are learned from at most this many documents per language (smallest id hash), from all n-grams of these.
SAMPLE_DOCS = 2000
HASHES = 3
#: A filter has at least PLACES places for each n-gram of the language with most of them, within these powers of two;
#: a fuller filter answers with more false positives, which are corrected for.
PLACES, LEAST_BITS, MOST_BITS = 8, 16, 24
#: Bytes of one bit-sliced table.  Languages that do not fit share a further table and a further pass over the texts.
TABLE_BYTES = 32 << 20
UNDETERMINED = "und"
_POINTS = 0x323B0
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-case form of every letter's code point, 0 for everything else."""
    if not _LETTER:
        out = np.zeros(_POINTS, dtype=np.uint32)
        for i in range(_POINTS):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _LETTER.append(out)
    return _LETTER[0]


def grams(texts: list[str | None]):
    """(n-gram code, row) for each window whose second place is a letter, and the rows that have a letter.

    Places that are no letters count as blanks; every text is set between blanks.
    """
    joined = "  ".join("" if t is None else t.replace("\0", " ") for t in texts)
    code = np.frombuffer(("  " + joined + "    ").encode("utf-32-le", "replace"), dtype=np.uint32)
    code = _letters()[np.where(code < _POINTS, code, 0)]
    size = np.array([0 if t is None else len(t) for t in texts], dtype=np.int64)
    begin = 2 + np.concatenate([[0], np.cumsum(size + 2)])[:-1] if len(size) else np.zeros(0, np.int64)
    at = np.flatnonzero(code)
    row = np.searchsorted(begin, at, side="right") - 1
    c = (code ^ (code >> np.uint32(16))) & np.uint32(0xFFFF)
    g = np.zeros(len(at), dtype=np.uint64)
    for j in range(GRAM):
        g = (g << np.uint64(16)) | c[at - 1 + j].astype(np.uint64)
    return g, row


def _places(g: np.ndarray, bits: int):
    """HASHES positions of each n-gram in a filter of 2**bits places, from the two halves of one 64-bit hash."""
    h = C.mix64(g ^ np.uint64(0x5851F42D4C957F2D))
    low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield ((low + np.uint64(i) * step) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _distinct(batches):
    for b in C.slices(batches):
        langs = np.array(b.column("lang").to_pylist(), dtype=object)
        texts = b.column("text").to_pylist()
        for lang in sorted(set(langs)):
            g = np.unique(grams([t for t, x in zip(texts, langs) if x == lang])[0])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64))], ["lang", "g"])


def _filter_words(bits: int):
    """Batches of (lang, g) to (lang, word, value): the set bits of the languages' filters, 64 to a word."""
    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            lang = b.column("lang").dictionary_encode()
            k = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) << bits
            g = b.column("g").to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate([k | p for p in _places(g, bits)]))
            word, start = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), start)
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(word >> (bits - 6))), pa.array(word & ((1 << (bits - 6)) - 1)), pa.array(value.view(np.int64))],
                ["lang", "word", "value"])
    return run


def _table(rows: pa.Table, langs: list[str], bits: int) -> dict:
    """The bit-sliced table of ``langs`` from the words of their filters."""
    table = np.zeros((1 << bits, -(-len(langs) // 8)), dtype=np.uint8)
    fill = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        mine = rows.filter(pc.equal(rows.column("lang"), lang))
        plane = np.zeros(1 << (bits - 6), dtype="<u8")
        plane[mine.column("word").to_numpy()] = mine.column("value").to_numpy().view(np.uint64)
        on = np.unpackbits(plane.view(np.uint8), bitorder="little")
        table[:, i // 8] |= on << np.uint8(i % 8)
        fill[i] = on.mean()
    return {"langs": langs, "bits": bits, "table": table, "false_positive": fill ** HASHES}


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, table_bytes: int = TABLE_BYTES) -> tuple[list[dict], str | None]:
    """The bit-sliced tables of all languages in their order, and the most frequent language; no tables without training rows.

    The driver holds one row per language, and the words of one table's filters at a time.
    """
    seen = (docs.where("lang is not null and text is not null and doc_id is not null")
            .where(C.crc_bucket(F.col("doc_id"), SPLIT) != HELD_OUT)
            .select(F.col("doc_id").cast("long").alias("doc_id"), "lang"))
    many = seen.groupBy("lang").count().collect()
    if not many:
        return [], None
    # a bound on the id hash lets about twice the wanted ids of a language into its window, however many it has
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 2 * sample_docs / r["count"])) for r in many],
                                              "lang string, share double")
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (seen.join(F.broadcast(share), "lang").where(low).withColumn("r", F.row_number().over(w))
           .where(F.col("r") <= sample_docs).select("doc_id", "lang").distinct())
    sample = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where("text is not null")
              .join(ids, ["doc_id", "lang"], "left_semi").select("lang", "text"))
    scratch = C.Scratch(docs.sparkSession, "langid")
    known = scratch.save(sample.mapInArrow(_distinct, "lang string, g long").distinct(), "grams")
    most = known.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    bits = min(max(int(PLACES * most - 1).bit_length(), LEAST_BITS), MOST_BITS)
    words = scratch.save(known.mapInArrow(_filter_words(bits), "lang string, word long, value long")
                         .groupBy("lang", "word").agg(F.bit_or("value").alias("value")), "words")
    langs = sorted(r["lang"] for r in many)
    per = max(1, (table_bytes >> bits) * 8)
    tables = []
    for i in range(0, len(langs), per):
        part = langs[i:i + per]  # sorted as Python sorts, so picked by name
        tables.append(_table(words.where(F.col("lang").isin(part)).toArrow(), part, bits))
    scratch.drop(known, words)
    return tables, min(many, key=lambda r: (-r["count"], r["lang"]))["lang"]


def language_counts(model: dict, g: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """False-positive corrected number of n-grams of each text that each language contains."""
    mask = None
    for p in _places(g, model["bits"]):
        m = model["table"][p]
        mask = m if mask is None else mask & m
    total = np.bincount(row, minlength=n_rows).astype(np.float64)
    out = np.empty((n_rows, len(model["langs"])))
    for i, f in enumerate(model["false_positive"]):
        hits = np.bincount(row, weights=(mask[:, i // 8] >> (i % 8)) & 1, minlength=n_rows)
        out[:, i] = np.maximum((hits - total * f) / max(1 - f, 1e-9), 0)
    return out


def _scorer(box, last: bool):
    """Adds one table's languages to (top, lang_top, total) of each text: the largest count, its language, all counts."""
    def run(batches):
        model = box.value
        names = np.array(model["langs"], dtype=object)
        for b in C.slices(batches, data_bytes=3 << 20):
            n = b.num_rows
            g, row = grams(b.column("text").to_pylist())
            c = language_counts(model, g, row, n)
            top, lang, total = c.max(axis=1), names[c.argmax(axis=1)], c.sum(axis=1)
            if "top" in b.schema.names:
                before = b.column("top").to_numpy(zero_copy_only=False)
                better = top > before
                lang = np.where(better, lang, np.array(b.column("lang_top").to_pylist(), dtype=object))
                top, total = np.maximum(top, before), total + b.column("total").to_numpy(zero_copy_only=False)
            letters = np.bincount(row, minlength=n) > 0
            out = {"doc_id": b.column("doc_id"), "letters": pa.array(letters), "top": pa.array(top), "lang_top": pa.array(lang, pa.string()),
                   "total": pa.array(total)} | ({} if last else {"text": b.column("text")})
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
    return run


def predict_language(spark: SparkSession, docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS,
                     table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    Learned from text and non-NULL lang of documents whose crc32(doc_id) modulo 3 is
    not 1.  A NULL text and one without a letter give `und` with score 0, as does any
    text when there is nothing to learn from.  A text of which no language contains
    an n-gram gets the most frequent language with score 0; ties go to the language
    that sorts first.  score is the winner's share of all corrected counts.
    Repeated rows and NULL ids get a row each; other columns are ignored.

    ``table_bytes`` bounds what is broadcast: with more languages than one table holds, the
    texts are read once per table, and the result is the same.
    """
    tables, default = train(docs, sample_docs, table_bytes)
    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not tables:
        return at.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    scratch = C.Scratch(spark, "langid")
    for i, t in enumerate(tables, 1):
        last = i == len(tables)
        box = spark.sparkContext.broadcast(t)
        done = at.mapInArrow(_scorer(box, last), "doc_id long, letters boolean, top double, lang_top string, total double"
                             + ("" if last else ", text string"))
        at = done if last else scratch.save(done, "pass")  # one table at a time in a worker
    hit = F.col("letters") & (F.col("top") > 0)
    name = F.when(~F.col("letters"), UNDETERMINED).when(hit, F.col("lang_top")).otherwise(default)
    return at.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), name.alias("lang_pred"),
                     F.when(hit, F.col("top") / F.col("total")).otherwise(0.0).alias("score"))
