"""Near-duplicate documents by circulant MinHash (C-MinHash).

Method: a document's shingle hashes go through a first permutation of the
64-bit hash space and then to a position on a circle of 2**22 places; a second,
fixed permutation of the circle, shifted by k places, gives coordinate k of the
signature as the smallest rank met.  Two permutations thus give all coordinates.
Coordinates are banded, documents that share a band are candidates, and every
link is confirmed on the full shingle sets (``neardup.link``).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sward.llm import common as C
from sward.llm.neardup import link, shared_buckets

CIRCLE_BITS = 22
#: Text handled at once: the arrays over it take some 40 bytes a byte.
SLICE_BYTES = 1 << 20
SEED = 77_003
#: 24 bands of 5 rows miss a pair at similarity 0.8 with probability (1 - 0.8**5)**24 = 7e-5.
BANDS, ROWS = 24, 5
SHINGLE_WORDS, THRESHOLD = 5, 0.8


@lru_cache(maxsize=2)
def circle(width: int) -> np.ndarray:
    """The second permutation, laid out so that row x holds its ``width`` shifts at place x."""
    ranks = np.random.Generator(np.random.PCG64(SEED)).permutation(np.uint32(1) << np.uint32(CIRCLE_BITS))
    ranks = ranks.astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[:width]]), width)


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    """C-MinHash coordinates of a non-empty set of 64-bit hashes."""
    place = C.mix64(shingles ^ np.uint64(SEED)) >> np.uint64(64 - CIRCLE_BITS)
    view = circle(width)
    best = None
    for at in range(0, len(place), 8192):  # bounded memory for very long texts
        low = view[place[at:at + 8192].astype(np.int64)].min(axis=0)
        best = low if best is None else np.minimum(best, low)
    return best


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    m = sig[:bands * rows].reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for j in range(rows):
        key = C.mix64(key + m[:, j])
    return key


def _fingerprints(k: int, bands: int, rows: int):
    def run(batches):
        for b in C.slices(batches, data_bytes=SLICE_BYTES):
            data, off = C.string_buffers(b.column("text"))
            h, row, _, _ = C.word_hashes(data, off)
            cut = C.row_slices(row, b.num_rows)
            s, at = C.shingle_sets(h, cut, k)
            sets = [s[at[i]:at[i + 1]] for i in range(b.num_rows)]
            ids = [C.set_digest(x) if len(x) else None for x in sets]
            keys = [band_keys(signature(x, bands * rows), bands, rows) if len(x) else x for x in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(ids, pa.binary()),
                 C.list_array(keys)], ["doc_id", "n", "set_id", "bands"])
    return run


def _sets(k: int):
    def run(batches):
        for b in C.slices(batches, data_bytes=SLICE_BYTES):
            data, off = C.string_buffers(b.column("text"))
            h, row, _, _ = C.word_hashes(data, off)
            cut = C.row_slices(row, b.num_rows)
            s, at = C.shingle_sets(h, cut, k)
            ids = [C.set_digest(s[at[i]:at[i + 1]]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.binary()), pa.array(np.diff(at), pa.int64()), C.flat_list(s, at)],
                ["set_id", "n", "s"])
    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS,
                    threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked when the Jaccard similarity of their sets of
    ``shingle_words``-word shingles is at least ``threshold``; component_id is the
    smallest doc_id reachable over links.  Words are runs of bytes other than
    space and 0x09-0x0D, A-Z lower-cased; a text with fewer words than a shingle
    is one shingle.  NULL, empty and blank texts have an empty set, are linked
    with nothing and are kept.  Equal sets form one class, so exact copies never
    become pairs.  Rows repeated with the same doc_id are all returned.  A row
    whose doc_id is NULL is linked with nothing (component_id NULL, kept).
    Candidates come from banded signatures, so a pair exactly at the threshold is
    missed with the probability stated at BANDS; a returned link is always exact.
    Columns other than doc_id and text are ignored.
    """
    scratch = C.Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fp = scratch.save(docs.mapInArrow(C.releasing(_fingerprints(shingle_words, bands, rows)),
                                      "doc_id long, n long, set_id binary, bands array<long>"), "fp")
    named = fp.where("set_id is not null and doc_id is not null")
    classes = named.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    buckets = shared_buckets(scratch, classes)
    candidates = buckets.select("set_id").distinct().join(
        named.groupBy("set_id").agg(F.min("doc_id").alias("doc_id")), "set_id")
    wanted = scratch.save(candidates, "wanted")
    texts = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(C.releasing(_sets(shingle_words)), "set_id binary, n long, s array<long>")
    sets = scratch.save(sets.join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"]), "sets")
    labels = link(scratch, buckets, sets, threshold)
    scratch.drop(buckets, sets, wanted)
    named2 = fp.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    comp = named2.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("low")) \
        .join(labels, "set_id", "left").select("set_id", "low", F.coalesce("comp", "set_id").alias("comp"))
    comp = scratch.save(comp, "comp")
    least = comp.groupBy("comp").agg(F.min("low").alias("component"))
    by_set = comp.join(least, "comp").select("set_id", "component")
    return (named2.join(by_set, "set_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, **params) -> DataFrame:
    """``docs`` without documents that are near copies of a document with a smaller id."""
    gone = near_duplicates(spark, docs, **params).where("not kept").select("doc_id").distinct()
    gone = C.Scratch(spark, "minhash-gone").save(gone, "gone")
    return docs.join(gone, "doc_id", "left_anti")
