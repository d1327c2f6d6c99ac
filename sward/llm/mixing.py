"""Mixing sources to target weights: capped water-filling, seeded whole and fractional repetitions.

Each source's share of the mix follows its weight, but no source is repeated more than
``epochs`` times: sources above that are clamped and what they leave is shared out among the
others by weight, until none is above.  A source of target = (k + f) times its size gives every
document k times, and once more the documents first in a seeded order that make up the fraction
f; the document at the end of the fraction gives the words that are missing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sward.llm import common as C
from sward.llm.neardup import control_files
from sward.llm.ranged import running_total

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, 42
#: Bytes looked at once; a longer text is counted in pieces.
PIECE = 1 << 20


def _is_start(piece: np.ndarray) -> np.ndarray:
    word = ~C.SPACE[piece]
    word[1:] &= C.SPACE[piece[:-1]]
    return word


def word_counts(column) -> np.ndarray:
    """Words (runs of bytes other than space and 0x09-0x0D) of every text; NULL has none."""
    data, off = C.string_buffers(column)
    out = np.zeros(len(off) - 1, dtype=np.int64)
    for lo in range(0, len(data), PIECE):
        piece = data[lo:lo + PIECE]
        first = _is_start(piece)
        if lo:
            first[0] &= C.SPACE[data[lo - 1]]
        heads = off[np.searchsorted(off, lo):np.searchsorted(off, lo + len(piece))] - lo
        first[heads] = ~C.SPACE[piece[heads]]
        out += np.bincount(np.searchsorted(off, np.flatnonzero(first) + lo, side="right") - 1, minlength=len(out))
    return out


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "th", "nul", "src")), pa.array(word_counts(b.column("text")))],
                                         ["doc_id", "th", "nul", "src", "size"])


def source_targets(scratch: C.Scratch, sources: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(nul, src, source_size, target) of sources (nul, src, source_size), one row each.

    Weights go round over the sources in code point order, NULL (nul = 1) last.
    """
    spark = scratch.spark
    one = scratch.save(sources.withColumn("one", F.lit(1).cast("long")), "sources", control_files(spark))
    numbered = running_total(scratch, one, [F.col("nul"), F.col("src")], "one", partitions=control_files(spark))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    table = scratch.save(numbered.select("nul", "src", "source_size", weight.alias("w")), "weights", control_files(spark))
    scratch.drop(one)
    whole = F.coalesce(F.sum("source_size"), F.lit(0))
    total, share = table.agg(whole, F.coalesce(F.sum("w"), F.lit(0))).first()
    words, clamped = int(total), -1

    def above():
        big = "decimal(19,0)"
        return F.col("w").cast(big) * F.lit(words).cast(big) > F.col("source_size").cast(big) * F.lit(epochs * share).cast(big)

    while share:  # one job a round; every round but the last clamps at least one more source
        over = above()
        got = table.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)),
                        F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0))).first()
        if got[0] == clamped:
            break
        clamped, words, share = got[0], int(total) - epochs * int(got[1]), int(got[2])
    if share:
        target = F.when(above(), F.col("source_size") * F.lit(float(epochs))).otherwise(
            F.col("w").cast("double") * F.lit(float(words)) / F.lit(float(share)))
    else:
        target = F.col("source_size") * F.lit(float(epochs))
    return table.select("nul", "src", "source_size", target.alias("target"))


def mix(spark: SparkSession, docs: DataFrame, *, weights: tuple = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, th, source, size, source_size, target, taken.

    size: words of the text (runs of bytes other than space and 0x09-0x0D; NULL: 0); source_size and target: words
    of the row's source in ``docs`` and in the mix; taken: words that the mix takes of this row, repeats counted: whole
    times the size, then the first words.  A source's taken words are its target rounded to a word.  th is a
    hash of the text that tells rows of one doc_id apart.

    The order of the fraction is the md5 of seed and doc_id, so reruns agree.  Rows without a doc_id come first; repeated
    rows are mixed each for itself.  Rows without a source are one source.  Empty texts have size 0 and give nothing; if
    all are empty, every target is 0.  Other columns are ignored.
    """
    scratch = C.Scratch(spark, "mixing")
    sized = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"),
                         F.col("source").isNull().cast("int").alias("nul"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
                         "text").mapInArrow(_sizes, "doc_id long, th long, nul int, src string, size long"))
    sized = scratch.save(sized.withColumn("place", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))), "sized")
    sources = source_targets(scratch, sized.groupBy("nul", "src").agg(F.sum("size").alias("source_size")), weights, epochs)
    sources = scratch.save(sources, "targets", control_files(spark))
    order = [F.col(c).asc() for c in ("nul", "src", "place", "doc_id", "size", "th")]
    placed = running_total(scratch, sized, order, "size", ("nul", "src"))
    scratch.drop(sized)
    # the totals of a source travel with its rows: one source may hold most of them, so they are broadcast
    # where Spark finds them small, else AQE splits the join
    both = placed.join(sources, ["nul", "src"])
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - F.col("times") * F.col("source_size") + F.lit(0.5))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return (both.withColumn("times", times).withColumn("rest", rest)
            .select("doc_id", "th", F.when(F.col("nul") == 0, F.col("src")).alias("source"), "size", "source_size", "target",
                    (F.col("times") * F.col("size") + part).cast("long").alias("taken")))


def _first_words(batches):
    """The texts cut behind their first ``words`` words."""
    for b in batches:
        out = []
        for text, k in zip(b.column("text").to_pylist(), b.column("words").to_pylist()):
            data = np.frombuffer(text.encode(), np.uint8)
            start = np.flatnonzero(_is_start(data))
            out.append(text if k >= len(start) else data[:start[k]].tobytes().decode().rstrip(" \t\n\x0b\x0c\r"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("epoch"), pa.array(out, pa.string())],
                                         ["doc_id", "source", "epoch", "text"])


def mixed_texts(spark: SparkSession, docs: DataFrame, **params) -> DataFrame:
    """The mix itself: doc_id, source, epoch (from 0) and text, one row per repetition that holds a word."""
    scratch = C.Scratch(spark, "mixed")
    # rows repeated whole are told apart by nothing: what they take together is dealt to one of them
    taken = (mix(spark, docs, **params).where("taken > 0").groupBy("doc_id", "th", "source")
             .agg(F.sum("taken").alias("taken"), F.first("size").alias("size")))
    taken = scratch.save(taken, "taken")
    texts = (docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_t"), F.col("source").cast("string").alias("_s"), "text")
             .dropDuplicates(["_d", "_t", "_s"]))
    both = taken.join(texts, taken["doc_id"].eqNullSafe(texts["_d"]) & (F.col("th") == F.col("_t")) & F.col("source").eqNullSafe(F.col("_s")))
    copies = both.select("doc_id", "source", "text", "taken", "size",
                         F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")) - 1)).alias("epoch"))
    return (copies.select("doc_id", "source", F.col("epoch").cast("int").alias("epoch"), "text",
                          F.least("size", F.col("taken") - F.col("epoch") * F.col("size")).alias("words"))
            .mapInArrow(_first_words, "doc_id long, source string, epoch int, text string"))
