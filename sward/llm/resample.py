"""Importance resampling towards a target distribution, on segments without repeats.

A text's features are its runs of 1 to 3 words, hashed into buckets.  Newlines are
separators, so texts fall into lines, and lines repeat: over the corpus every distinct
line is counted once, its bucket counts times its occurrences.  Runs that span lines are
added separately.  Bucket counts of corpus and target give a gain for each bucket; a
document's weight is the sum of its features' gains, and the highest weights with seeded
Gumbel noise are drawn (sampling without replacement).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sward.llm import common as C
from sward.llm.crcgrams import gram_crcs, word_registers
from sward.llm.ranged import running_total

BUCKETS, LONGEST = 10_000, 3
MIN_WORDS, PERCENT, SEED = 20, 5, 42
#: Text taken apart at once; the arrays of a pass take about 40 times as much.
SLICE_BYTES = 1 << 20
#: Bytes of words after folding A-Z: digits, a-z and all bytes of characters beyond ASCII.
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


class Segments:
    """Words and lines of a batch of texts."""

    def __init__(self, column):
        data, off = C.string_buffers(column)
        d = C._LOWER[data]
        word = np.zeros(len(d) + 2, dtype=np.int8)
        word[1:-1] = _WORD[d]
        edge = np.diff(word)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cuts = off[1:-1]
        inside = cuts[(cuts > 0) & (cuts < len(d))]
        inside = np.unique(inside[(word[inside] > 0) & (word[inside + 1] > 0)])  # a word runs over a text's end
        if len(inside):
            start, end = np.sort(np.concatenate([start, inside])), np.sort(np.concatenate([end, inside]))
        self.data, self.start, self.end, self.size = d, start, end, end - start
        self.texts = len(off) - 1
        self.row = np.searchsorted(off, start, side="right") - 1
        newline = np.cumsum(d == 10)[start] if len(d) else start
        first = np.ones(len(start), dtype=bool)
        first[1:] = (self.row[1:] != self.row[:-1]) | (newline[1:] != newline[:-1])
        self.line = np.cumsum(first) - 1
        self.head = np.flatnonzero(first)
        self.tail = np.append(self.head[1:], len(start)) - 1 if len(start) else self.head

    def line_bytes(self) -> list[bytes]:
        """Each line with a word, from its first word to its last."""
        whole = self.data.tobytes()
        return [whole[a:b] for a, b in zip(self.start[self.head].tolist(), self.end[self.tail].tolist())]

    def grams(self, buckets: int, lines: np.ndarray | None = None):
        """(bucket, first word) of the runs inside ``lines`` (numbers, all if None), then of those that span lines."""
        register = word_registers(self.data, self.start, self.end)
        n = len(register)
        wanted = np.ones(len(self.head), dtype=bool)
        if lines is not None:
            wanted[:] = False
            wanted[lines] = True
        inside, across = [], []
        for k in range(1, LONGEST + 1):
            i = np.arange(max(0, n - k + 1))
            same = self.line[i] == self.line[i + k - 1]
            for kind, some in ((inside, same & wanted[self.line[i]]),
                               (across, ~same & (self.row[i] == self.row[i + k - 1]))):
                at = i[some]
                kind.append((gram_crcs(register, self.size, at, k).astype(np.int64) % buckets, at))
        return [tuple(np.concatenate(x) for x in zip(*kind)) for kind in (inside, across)]


def _segments(buckets: int):
    """Rows (line, bucket, c): distinct lines of a slice and how often they occur; bucket counts of runs over lines."""
    def run(batches):
        across = np.zeros(buckets, dtype=np.int64)
        for b in C.slices(batches, data_bytes=SLICE_BYTES):
            s = Segments(b.column("text"))
            seen: dict[bytes, int] = {}
            for line in s.line_bytes():
                seen[line] = seen.get(line, 0) + 1
            across += np.bincount(s.grams(buckets, np.zeros(0, np.int64))[1][0], minlength=buckets)
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seen.keys(), pa.binary()), pa.nulls(len(seen), pa.int32()), pa.array(seen.values(), pa.int64())],
                    ["line", "bucket", "c"])
        at = np.flatnonzero(across)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.binary()), pa.array(at.astype(np.int32)),
                                              pa.array(across[at])], ["line", "bucket", "c"])
    return run


def _bucket_counts(buckets: int):
    """Rows (bucket, c) of a task: features of its distinct lines times their occurrences, and the runs over lines."""
    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in C.slices(batches, rows=1 << 16, data_bytes=SLICE_BYTES, text="line"):
            c = b.column("c").to_numpy()
            bucket = b.column("bucket")
            over = bucket.is_valid().to_numpy(zero_copy_only=False)
            np.add.at(total, bucket.drop_null().to_numpy(), c[over])
            s = Segments(b.column("line"))  # a row is one line
            of, at = s.grams(buckets)[0]
            np.add.at(total, of, c[s.row[at]])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "c"])
    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all ``texts`` (text) by bucket; the driver gets at most ``buckets`` numbers."""
    lines = (texts.select("text").mapInArrow(_segments(buckets), "line binary, bucket int, c long")
             .groupBy("line", "bucket").agg(F.sum("c").alias("c")))
    found = (lines.mapInArrow(_bucket_counts(buckets), "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c"))
             .toArrow())
    out = np.zeros(buckets, dtype=np.int64)
    out[found.column("bucket").to_numpy()] = found.column("c").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in the target over that in the corpus) of every bucket."""
    n = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (corpus.sum() + n)) / ((s + 1) * (target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weights(gain: np.ndarray):
    """Rows (doc_id, n_words, n_features, weight); the lines of a slice that repeat are weighed once."""
    def run(batches):
        for b in C.slices(batches, data_bytes=SLICE_BYTES):
            s = Segments(b.column("text"))
            number: dict[bytes, int] = {}
            of = np.array([number.setdefault(line, len(number)) for line in s.line_bytes()], dtype=np.int64)
            rep = np.unique(of, return_index=True)[1]  # the first line of each kind
            (bucket, at), (cross, cross_at) = s.grams(len(gain), rep)
            line_weight = np.zeros(len(s.head), dtype=np.int64)
            np.add.at(line_weight, s.line[at], gain[bucket])
            weight = np.zeros(s.texts, dtype=np.int64)
            if len(of):
                np.add.at(weight, s.row[s.head], line_weight[rep][of])
            np.add.at(weight, s.row[cross_at], gain[cross])
            n = np.bincount(s.row, minlength=s.texts).astype(np.int64)
            features = sum(np.maximum(n - k, 0) for k in range(LONGEST))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(features), pa.array(weight)],
                                             ["doc_id", "n_words", "n_features", "weight"])
    return run


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
             percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_features, weight, score, rank.

    ``target``: (text), the distribution to draw towards.  score is the weight plus floor(1000 * Gumbel noise), the
    noise a hash of seed and doc_id.  Of the N rows with at least ``min_words`` words, floor(percent * N / 100) are
    drawn, those with the highest score, ties to the smaller doc_id; rank is 1, 2, 3 ... in that order and NULL for
    the others.  NULL, empty and wordless texts have no features and weight 0.  A row without a doc_id counts in the
    corpus and has a weight, but no score and no part in the draw.  Rows of equal doc_id have the same noise
    and are drawn each for itself.  An empty target gives gains against the smoothing alone; an empty ``docs`` no row.
    Other columns are ignored.
    """
    scratch = C.Scratch(spark, "resample")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    weighed = docs.mapInArrow(_weights(gain), "doc_id long, n_words long, n_features long, weight long")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10)
    uniform = (noise.cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))
    weighed = weighed.withColumns({
        "score": F.col("weight") + gumbel,
        "one": F.lit(1).cast("long"),
        "out": (F.col("n_words") < min_words) | F.col("doc_id").isNull()})
    weighed = scratch.save(weighed, "weighed")
    drawn = weighed.where("not out").count() * percent // 100
    order = [F.col("out").asc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("weight").asc(), F.col("n_features").asc()]
    ranked = running_total(scratch, weighed, order, "one")
    scratch.drop(weighed)
    place = F.col("before") + 1
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score",
                         F.when(~F.col("out") & (place <= drawn), place).alias("rank"))
