"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is the hash of the tokens at the care positions of a fixed mask; the
other positions of its window are ignored, so a substituted token there does
not hide a copy.  Training and test seeds are joined, and around each hit the
aligned texts are compared token by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Care positions of the spaced masks; every mask spans SPAN tokens.
MASKS = ((0, 1, 3, 4, 7, 9), (0, 2, 3, 5, 8, 9), (0, 1, 2, 4, 6, 9))
SPAN = 10
#: Also runs of tokens: a leak's window with at most two substitutions (0.8 of 10 to 13 tokens) keeps a run of
#: RUN tokens, of SHORT_RUN where it has under 12; one with at most one (5 to 9 tokens) keeps a half of the item.
RUN, SHORT_RUN = 4, 3
#: A leak: this many consecutive aligned tokens (the whole item if it is shorter) ...
MIN_TOKENS = 13
#: ... of which at least this share is equal.
MIN_MATCH = 0.8
#: Test seeds are broadcast up to this many rows of four numbers (about 50 MB as a hash table, whatever the length
#: of the items); a larger benchmark is joined by shuffle.
BROADCAST_ROWS = 500_000


def token_hashes(text: Column) -> Column:
    """64-bit hash of each token: runs of letters and digits, lower case."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(words, lambda w: F.xxhash64(w))


def runs(n: int) -> list[tuple[int, int | None]]:
    """(tokens, place or None for every place) of the runs that are seeds of an item of ``n`` tokens."""
    if n < 5:
        return [(n, 0)]
    if n < SPAN:
        return [(n // 2, 0), (n - n // 2, n // 2)]
    return [(SHORT_RUN if n < 12 else RUN, None)]


def _seed(h: Column, pos: Column, mask: tuple, when: Column | bool = True) -> Column:
    """The seed of a mask at ``pos``, NULL where the text ends before."""
    return F.when((pos + mask[-1] < F.size(h)) & when, F.xxhash64(F.lit(str(mask)), *[F.get(h, pos + F.lit(o)) for o in mask]))


def _explode(df: DataFrame, seeds, *keep: str) -> DataFrame:
    """(keep..., h, pos, seed) for every place of every row of (keep..., h)."""
    at = df.select(*keep, "h", F.posexplode("h").alias("pos", "_t"))
    return (at.select(*keep, "h", "pos", F.explode(F.array(*seeds(F.col("h"), F.col("pos")))).alias("seed"))
            .where("seed is not null"))


def _item_seeds(h: Column, pos: Column) -> list[Column]:
    n = F.size(h)
    out = [_seed(h, pos, m) for m in MASKS] + [_seed(h, pos, tuple(range(RUN)), n >= 12)]
    for size in range(1, 12):
        out += [_seed(h, pos, tuple(range(k)), (n == size) & (F.lit(True) if at is None else pos == at)) for k, at in runs(size)]
    return out


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, min_tokens: int = MIN_TOKENS,
          min_match: float = MIN_MATCH, min_item: int = 1, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Benchmark passages found in ``docs``: one row per (doc_id, item_id).

    docs: (doc_id, text), benchmark: (item_id, text).  Returns doc_id, item_id,
    doc_token and item_token (where the aligned texts start, from 0), n_aligned,
    n_equal, best_window (equal tokens in the best window of
    min(min_tokens, tokens of the item) tokens).  Of several alignments the one with
    most equal tokens is returned, ties to the earlier.  NULL and empty texts and
    NULL ids give no row; repeated rows count once.  Other columns are ignored.  Items of fewer than
    ``min_item`` tokens are not searched; with the default an item of one word is found wherever the word is.
    """
    items = (benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"),
                                                           token_hashes(F.col("text")).alias("h"))
             .withColumn("h", F.filter("h", lambda x: x != F.xxhash64(F.lit("")))))
    items = items.where(F.size("h") >= min_item).distinct().withColumn("it", F.xxhash64("h"))
    # seeds travel without their items; ids may repeat with other texts, so a hash of the tokens goes along
    test = _explode(items, _item_seeds, "item_id", "it").select("seed", "item_id", "it", F.col("pos").alias("item_pos"))
    small = test.count() <= broadcast_rows
    sizes = [r[0] for r in items.select(F.least(F.size("h"), F.lit(12)).alias("n")).distinct().collect()]  # 12 at most
    lengths = sorted({k for n in sizes for k, _ in runs(n)})
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), token_hashes(F.col("text")).alias("h"))

    def train(*keep: str) -> DataFrame:
        return _explode(texts.withColumn("dt", F.xxhash64("h")),
                        lambda h, pos: [_seed(h, pos, m) for m in (*MASKS, *[tuple(range(k)) for k in lengths])], "doc_id", *keep)

    item = items.select("item_id", "it", F.col("h").alias("ih"))  # joined to the hits; Spark's size check picks the way
    if small:
        hits = train().join(F.broadcast(test), "seed").join(item, ["item_id", "it"])
    else:  # the texts stay behind: only seeds are shuffled, and hit documents are read again
        hits = (train("dt").drop("h").join(test, "seed")
                .select("doc_id", "dt", "item_id", "it", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
                .join(texts.withColumn("dt", F.xxhash64("h")), ["doc_id", "dt"]).join(item, ["item_id", "it"])
                .withColumns({"pos": F.col("shift"), "item_pos": F.lit(0)}))
    # aligned stretches: document token shift + i against item token i
    shift = F.col("pos") - F.col("item_pos")
    hits = hits.select("doc_id", "item_id", shift.alias("shift"), "ih",
                       F.greatest(F.lit(0), -shift).alias("lo"),
                       F.least(F.size("ih"), F.size("h") - shift).alias("hi"), "h")
    hits = hits.select("doc_id", "item_id", "shift", "lo", F.col("ih").alias("item"),
                       F.slice("h", F.col("shift") + F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("a"))
    hits = hits.dropDuplicates(["doc_id", "item_id", "shift", "a"])
    window = F.least(F.lit(min_tokens), F.size("item"))
    same = hits.select("doc_id", "item_id", "shift", "lo", window.alias("w"),
                       F.expr("zip_with(a, slice(item, lo + 1, size(a)), (x, y) -> if(x = y, 1, 0))").alias("eq"))
    best = F.expr("array_max(transform(sequence(0, size(eq) - w), i -> aggregate(slice(eq, i + 1, w), 0, (s, x) -> s + x)))")
    found = (same.where("size(eq) >= w")
             .select("doc_id", "item_id", F.greatest("shift", F.lit(0)).cast("long").alias("doc_token"),
                     F.col("lo").cast("long").alias("item_token"), F.size("eq").cast("long").alias("n_aligned"),
                     F.expr("aggregate(eq, 0, (s, x) -> s + x)").cast("long").alias("n_equal"),
                     best.cast("long").alias("best_window"), "w")
             .where(F.col("best_window") >= F.ceil(F.col("w") * F.lit(min_match))))
    top = F.max_by(F.struct("doc_token", "item_token", "n_aligned", "n_equal", "best_window"),
                   F.struct("n_equal", -F.col("doc_token"), -F.col("item_token"))).alias("t")
    return found.groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", "t.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage (rows without an id stay)."""
    from sward.llm.common import Scratch
    bad = Scratch(spark, "leaks").save(leaks(spark, docs, benchmark, **params).select("doc_id").distinct(), "bad", 8)
    return docs.join(bad, "doc_id", "left_anti")
