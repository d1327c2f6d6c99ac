"""Repeated passages: paragraph MinHash banding, exact Jaccard, clusters of removals.

A paragraph is a passage of the running text, whatever its line breaks: the words are cut where
the hash of two neighbouring words is the smallest among its neighbours, so equal stretches of two
texts are cut alike wherever they stand.  A paragraph's set of 5-word shingles gets a MinHash sketch of the
bottom-k kind: its smallest hashes under one hash function, as many as a similar set cannot all be without
(``sketch_sizes``), so that no pair at the threshold is missed, however short the paragraphs are.  Shingles that are
frequent in a sample of the documents count as the largest, so that unrelated paragraphs rarely meet; any
order that all sets share would find the same pairs.  Each hash is a band.  With a ``recall`` below 1 the signature is of independent hash functions instead and ``tune_bands`` picks the
cheapest banding that reaches it.  Paragraphs that share a band are compared on their full sets and links
are merged into components over all documents.  Neighbouring paragraphs with copies elsewhere form a span;
spans of enough words count, and of each component the occurrence with the smallest (doc_id, text, para) stays.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sward.llm import common as C
from sward.llm.neardup import link

SHINGLE_WORDS, THRESHOLD = 5, 0.8
#: A cut is the smallest of CONTEXT words on both sides: paragraphs of 2 * CONTEXT + 1 words on average ...
CONTEXT = 8
#: ... and at most MAX_WORDS.
MAX_WORDS = 64
#: Words of a span that repeats; shorter ones (headings, licence lines, signatures) are ordinary boilerplate.
MIN_WORDS = 20
#: Share of the pairs at the threshold that are found at least.
RECALL = 1.0
#: Sets of at least so many shingles are banded.
NEAR_SHINGLES = 1
#: Documents in which frequent shingles are counted: so many, or a SAMPLE_SHARE of all if that is more; and how many shingles are told apart.
SAMPLE_DOCS, SAMPLE_SHARE, FREQUENT = 4000, 1 / 12, 1 << 16
#: Bytes of text looked at once; a longer text is looked at in pieces that end at white space.
SLICE_BYTES = 1 << 20
#: Words on both sides that tell whether a text is cut at a place: CONTEXT of them, and one more.
MARGIN = 2 * CONTEXT


def tune_bands(threshold: float, recall: float, max_rows: int = 3) -> tuple[int, int]:
    """(bands, rows) of the fewest hash functions, then the fewest bands, with 1 - (1 - threshold**rows)**bands >= recall.

    One row is plenty for 5-word shingles: unrelated paragraphs share almost none.
    """
    options = []
    for rows in range(1, max_rows + 1):
        bands = 1
        while 1 - (1 - threshold ** rows) ** bands < recall:
            bands += 1
        options.append((bands * rows, bands, rows))
    return min(options)[1:]


def _multipliers(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(5_150)).integers(1, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(s: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (sets x bands) of MinHash signatures under independent hash functions.

    ``s`` holds non-empty sets one after the other, starting at ``at[:-1]``.
    """
    out = np.empty((len(at) - 1, bands), dtype=np.uint64)
    mult = _multipliers(bands * rows)
    for b in range(bands):
        key = np.uint64((b + 1) * 0x224BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)
        for r in range(rows):
            key = C.mix64(key + np.minimum.reduceat(C.mix64(s * mult[b * rows + r]), at[:-1]))
        out[:, b] = key
    return out


def sketch_sizes(n: np.ndarray, pct: int) -> np.ndarray:
    """Smallest hashes that the sketches of sets of n elements hold; 0 where only an equal set is similar.

    A set with a similarity of pct % shares at least ceil(pct n / 100) elements with one of n, so it cannot be
    without all of the first n - ceil(pct n / 100) + 1 in any order common to both; and the smallest shared one
    is among the first so many of both sets.  n / (n + 1) is the largest similarity of unequal sets.
    """
    return np.where(n * (100 - pct) >= pct, n + (-pct * n) // 100 + 1, 0)


def frequent_last(s: np.ndarray, at: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The sets (each sorted) with their frequent elements behind the others; frequent: (sorted elements, places from 1)."""
    if len(frequent[0]) == 0 or len(s) == 0:
        return s
    i = np.minimum(np.searchsorted(frequent[0], s), len(frequent[0]) - 1)
    place = np.where(frequent[0][i] == s, frequent[1][i], 0)
    some = np.add.reduceat(place > 0, at[:-1], dtype=np.int64) > 0
    n = np.diff(at)
    moved = np.flatnonzero(np.repeat(some, n))
    out = s.copy()
    out[moved] = s[moved][np.lexsort((s[moved], place[moved], np.repeat(np.arange(len(n)), n)[moved]))]
    return out


def _pieces(batches):
    """(doc_id, th, first character, number of the piece, texts as bytes) of slices; long texts in pieces at white space."""
    for b in C.slices(batches, data_bytes=SLICE_BYTES):
        text = b.column("text").cast(pa.large_binary())
        ids, th = b.column("doc_id"), b.column("th")
        if b.num_rows > 1 or (pc.binary_length(text)[0].as_py() or 0) <= 2 * SLICE_BYTES:
            zero = np.zeros(b.num_rows, np.int64)
            yield ids, th, zero, zero, text
            continue
        data, _ = C.string_buffers(text)
        at, chars, n = 0, 0, 0
        while at < len(data):
            to = min(at + SLICE_BYTES, len(data))
            while to < len(data):  # on to the next white space, looked for in steps
                space = np.flatnonzero(C.SPACE[data[to:to + 4096]])
                to = to + int(space[0]) if len(space) else min(to + 4096, len(data))
                if len(space):
                    break
            piece = data[at:to]
            yield ids, th, np.array([chars]), np.array([n]), pa.array([piece.tobytes()], pa.large_binary())
            chars += int(np.count_nonzero((piece & 0xC0) != 0x80))
            at, n = to, n + 1


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i], ..., x[i + w - 1] (shorter at the end)."""
    out, have = x.copy(), 1
    while have < w:
        step = min(have, w - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _smallest_cuts(h: np.ndarray, row: np.ndarray, context: int = CONTEXT) -> np.ndarray:
    """``cut_points`` of paragraphs of any length; but for a text's first word they depend on the words around them alone."""
    n = len(h)
    first = np.ones(n, dtype=bool)
    first[1:] = row[1:] != row[:-1]
    pair = C.mix64(h * np.uint64(3) + np.uint64(7))
    pair[1:] = C.mix64(pair[1:] + h[:-1])
    pair = np.minimum(pair, np.uint64(0xFFFFFFFFFFFFFFFE))
    # texts lie apart by the context, so that no text looks into another
    place = np.arange(n) + row * context + context
    x = np.full(int(place[-1]) + 2 * context + 1, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    x[place] = np.where(first, np.uint64(0xFFFFFFFFFFFFFFFF), pair)
    ahead = _window_min(x, context)
    cut = first | ((pair < ahead[place + 1]) & (pair < ahead[place - context]))
    # a word said five times or more is a paragraph of its own: it has no smallest neighbour
    same = np.zeros(n, dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & ~first[1:]
    fifth = same.copy()
    for j in (1, 2, 3):
        fifth[j:] &= same[:-j]
        fifth[:j] = False
    cut[np.flatnonzero(fifth[1:] & ~fifth[:-1]) - 3] = True
    cut[np.flatnonzero(fifth[:-1] & ~fifth[1:]) + 1] = True
    # no other cuts inside it
    deep = fifth.copy()
    for j in (1, 2, 3):
        deep[:-j] |= fifth[j:]
    return np.flatnonzero(cut & (first | ~deep))


def _at_most(at: np.ndarray, n: int, max_words: int = MAX_WORDS) -> np.ndarray:
    """The cuts ``at`` of n words, and more of them where paragraphs would be longer than max_words."""
    size = np.diff(np.append(at, n))
    long = np.flatnonzero(size > max_words)
    if len(long):
        more = [np.arange(at[i] + max_words, at[i] + size[i], max_words) for i in long.tolist()]
        at = np.sort(np.concatenate([at, *more]))
    return at


def cut_points(h: np.ndarray, row: np.ndarray, context: int = CONTEXT, max_words: int = MAX_WORDS) -> np.ndarray:
    """First words of the paragraphs of texts given by their word hashes and row numbers."""
    return _at_most(_smallest_cuts(h, row, context), len(h), max_words)


def _words(text):
    """(hash, row, first character, character behind the last) of the words of texts."""
    data, off = C.string_buffers(text)
    h, row, start, end = C.word_hashes(data, off)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
    return h, row, chars[start] - chars[off[row]], chars[end] - chars[off[row]]


def _shingled(h, row, begin, stop, at: np.ndarray, to: int, k: int):
    """``_paragraphs`` that start at the words ``at``, the last one ending before the word ``to``."""
    if len(at) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, h[:0], np.zeros(1, np.int64)
    size = np.diff(np.append(at, to))
    r = row[at]
    number = np.arange(len(at)) - np.searchsorted(r, r)
    s, cut = C.shingle_sets(h[at[0]:to], np.append(at, to) - at[0], k)
    long = size >= k
    keep = np.repeat(long, np.diff(cut))
    return (r[long], number[long], begin[at[long]].astype(np.int64), stop[at[long] + size[long] - 1].astype(np.int64), size[long], s[keep],
            np.concatenate([[0], np.cumsum(np.diff(cut)[long])]))


def _paragraphs(text, k: int):
    """(row, number, first character, character behind the last, words) of the paragraphs of at least k words, shingles, set offsets."""
    h, row, begin, stop = _words(text)
    at = cut_points(h, row) if len(h) else np.zeros(0, np.int64)
    return _shingled(h, row, begin, stop, at, len(h), k)


def _in_pieces(pieces, k: int):
    """``_paragraphs`` of one text that comes in pieces, the same as of the whole text.

    The words behind a piece's last sure cut, and those before it that later cuts look back on, go on to the next piece.
    """
    held, done, numbered = None, 0, 0  # words, how many of them are in paragraphs already, paragraphs so far
    piece = next(pieces, None)
    while piece is not None:
        *_, chars, _, text = piece
        piece = next(pieces, None)
        h, _, begin, stop = _words(text)
        words = [h, begin + chars[0], stop + chars[0]]
        if held:
            words = [np.concatenate(x) for x in zip(held, words)]
        n = len(words[0])
        row, at = np.zeros(n, np.int64), np.zeros(0, np.int64)
        if n:
            at = _smallest_cuts(words[0], row)
            at = _at_most(np.append(done, at[at > done]), n)
        sure = at[at <= n - MARGIN]
        to = n if piece is None else int(sure[-1]) if len(sure) else done
        at = at[at < to]
        r, number, *rest = _shingled(words[0], row, *words[1:], at, to, k)
        yield r, number + numbered, *rest
        keep = max(to - MARGIN, 0)
        held, done, numbered = [x[keep:] for x in words], to - keep, numbered + len(at)


def _sliced(batches, k: int):
    """(doc_id, th) of slices and the ``_paragraphs`` of their texts; long texts in several yields."""
    for b in C.slices(batches, data_bytes=SLICE_BYTES):
        pieces = _pieces([b])
        first, second = next(pieces), next(pieces, None)
        found = [_paragraphs(first[-1], k)] if second is None else _in_pieces(itertools.chain((first, second), pieces), k)
        for x in found:
            yield *first[:2], *x


def _digests(s: np.ndarray, at: np.ndarray) -> list[bytes]:
    """``set_digest`` of every set."""
    from xxhash import xxh3_128_digest
    data, cut = memoryview(s.tobytes()), (8 * at).tolist()
    return [xxh3_128_digest(data[i:j]) for i, j in zip(cut, cut[1:])]


def _fingerprints(k: int, bands: int, rows: int, near: int, pct: int | None = None, frequent=None):
    """Paragraphs with their sets' digests and keys: bands of rows, or with ``pct`` the sketch for similarities of pct %."""
    names = ["doc_id", "th", "para", "start", "end", "n_words", "set_id", "keys"]

    def run(batches):
        for ids, th, r, number, begin, stop, size, s, at in _sliced(batches, k):
            if len(r) == 0:
                continue
            n = np.diff(at)
            if pct is None:
                held = np.where(n >= near, bands, 0)
                some = np.repeat(held > 0, n)
                keys = band_keys(s[some], np.concatenate([[0], np.cumsum(n[held > 0])]), bands, rows).ravel() if some.any() else s[:0]
            else:
                held = np.where(n >= near, sketch_sizes(n, pct), 0)
                keys = frequent_last(s, at, frequent.value)[np.arange(len(s)) - np.repeat(at[:-1], n) < np.repeat(held, n)]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(r)), th.take(pa.array(r)), pa.array(number), pa.array(begin),
                 pa.array(stop), pa.array(size.astype(np.int64)), pa.array(_digests(s, at), pa.binary()),
                 C.flat_list(keys, np.concatenate([[0], np.cumsum(held)]))], names)
    return run


def _frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT shingles that several distinct paragraphs of a sample have, sorted, and their places from the rarest on."""
    def run(batches):
        for *_, s, at in _sliced(batches, k):
            if len(at) > 1:
                yield pa.RecordBatch.from_arrays([C.flat_list(s, at)], ["s"])

    rows = docs.count()
    share = max(SAMPLE_SHARE, SAMPLE_DOCS / max(rows, 1))
    some = docs if share >= 1 else docs.sample(share, 17)
    counts = some.mapInArrow(C.releasing(run), "s array<long>").distinct().select(F.explode("s").alias("e")).groupBy("e").agg(F.count("*").alias("f"))
    top = counts.where("f > 1").orderBy(F.desc("f"), "e").limit(FREQUENT).toArrow()  # bounded by FREQUENT
    e = top.column("e").to_numpy().view(np.uint64)
    order = np.argsort(e)
    return e[order], (len(e) - np.arange(len(e)))[order]


def _sets(k: int):
    """(class, n, s) of the paragraphs of the texts whose sets are wanted (wanted: set_id, class)."""
    def run(batches):
        for b in C.slices(batches, data_bytes=SLICE_BYTES):
            # a class is wanted of one doc_id, and its set is the same wherever it is met
            wanted = b.column("wanted").flatten()
            wanted = dict(zip(*(pc.struct_field(wanted, c).to_pylist() for c in ("set_id", "class"))))
            for *_, s, at in _sliced([b], k):
                found = [wanted.pop(x, -1) for x in _digests(s, at)]
                held = np.array(found, np.int64) >= 0
                if held.any():
                    n = np.diff(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(found, np.int64)[held]), pa.array(n[held]),
                         C.flat_list(s[np.repeat(held, n)], np.concatenate([[0], np.cumsum(n[held])]))], ["class", "n", "s"])
    return run


def repeated_paragraphs(spark: SparkSession, docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS,
                        threshold: float = THRESHOLD, min_words: int = MIN_WORDS, recall: float = RECALL,
                        near_shingles: int = NEAR_SHINGLES) -> DataFrame:
    """Paragraphs of ``docs`` (doc_id, text) in passages that repeat across documents.

    One row per paragraph: doc_id, th (a hash of the text), para (its number), start, end (character span in the text),
    n_words, span_start and span_words (the span it is in: paragraphs with copies in other documents that follow one another,
    one without between them at most; words with copies), cluster_doc_id and cluster_para (the occurrence that stays: the smallest), removed (false for that one).
    Only spans of at least ``min_words`` words count, and components that then still are in two documents.

    Paragraphs link if their sets are equal, or if both have ``near_shingles`` shingles or more and a similarity of ``threshold``
    (to the full percent).  With a ``recall`` below 1, a pair at the threshold is found with that probability only.
    Paragraphs of fewer than ``shingle_words`` words take no part, nor do NULL, empty and blank texts and rows whose doc_id
    is NULL.  Paragraphs that repeat only under one doc_id are left alone.  Rows repeated whole count once; rows of one
    doc_id with different texts are parts of one document, told apart by th.  Other columns are ignored.
    """
    scratch = C.Scratch(spark, "paragraphs")
    pct = round(threshold * 100) if recall >= 1 else None
    bands, rows = tune_bands(threshold, recall) if pct is None else (0, 0)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    frequent = None if pct is None else spark.sparkContext.broadcast(_frequent(docs, shingle_words))
    fp = scratch.save(docs.mapInArrow(
        C.releasing(_fingerprints(shingle_words, bands, rows, near_shingles, pct, frequent)),
        "doc_id long, th long, para long, start long, end long, n_words long, set_id binary, keys array<long>"), "fp")
    # distinct sets that repeat or may have near copies, under a short number of their own; the keys belong to the set
    classes = fp.groupBy("set_id", "keys").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
    classes = scratch.save(classes.where((F.col("doc_id") < F.col("last")) | (F.size("keys") > 0))
                           .withColumn("class", F.monotonically_increasing_id()), "classes")
    # shuffled once: with the frequent shingles last, keys of many classes are few
    keys = classes.select(F.col("class").alias("set_id"), F.explode("keys").alias("key"))
    mates = F.count("*").over(Window.partitionBy("key"))
    buckets = scratch.save(keys.withColumn("mates", mates).where("mates > 1").select("key", "set_id"), "shared")
    # as many as a document has paragraphs
    wanted = (classes.select("set_id", "doc_id", "class")
              .join(buckets.select(F.col("set_id").alias("class")).distinct(), "class", "left_semi")
              .groupBy("doc_id").agg(F.collect_list(F.struct("set_id", "class")).alias("wanted")))
    sets = docs.join(wanted, "doc_id").mapInArrow(C.releasing(_sets(shingle_words)), "class long, n long, s array<long>")
    sets = scratch.save(sets.dropDuplicates(["class"]).withColumnRenamed("class", "set_id"), "sets")
    labels = link(scratch, buckets, sets, threshold, matches=1).select(F.col("set_id").alias("class"), "comp")
    scratch.drop(buckets, sets)
    # clusters: linked classes, and single classes that occur in several documents
    comp = classes.join(labels, "class", "left").select("set_id", "doc_id", "last", F.coalesce("comp", "class").alias("comp"))
    spread = comp.groupBy("comp").agg(F.min("doc_id").alias("lo"), F.max("last").alias("hi")).where("lo < hi").select("comp")
    member = scratch.save(comp.join(spread, "comp").select("set_id", "comp"), "member")
    scratch.drop(classes)
    hits = scratch.save(fp.drop("keys").join(member, "set_id").drop("set_id").dropDuplicates(["doc_id", "th", "para"]), "hits")
    scratch.drop(fp, member)
    # spans of a text; a text's paragraphs are as many as its words at most
    order = Window.partitionBy("doc_id", "th").orderBy("para")
    new = F.coalesce(F.col("para") - F.lag("para").over(order) > 2, F.lit(True)).cast("int")
    spans = hits.withColumn("new", new).withColumn("span", F.sum("new").over(order)).drop("new")
    of_span = Window.partitionBy("doc_id", "th", "span")
    spans = (spans.withColumn("span_words", F.sum("n_words").over(of_span)).withColumn("span_start", F.min("start").over(of_span))
             .where(F.col("span_words") >= min_words))
    occ = scratch.save(spans.drop("span"), "occ")
    scratch.drop(hits)
    keep = (occ.groupBy("comp").agg(F.min(F.struct("doc_id", "th", "para")).alias("k"), F.max("doc_id").alias("hi"))
            .where("k.doc_id < hi").select("comp", "k"))
    at = F.struct("doc_id", "th", "para")
    return (occ.join(keep, "comp")
            .select("doc_id", "th", "para", "start", "end", "n_words", "span_start", "span_words", F.col("k.doc_id").alias("cluster_doc_id"),
                    F.col("k.para").alias("cluster_para"), (at != F.col("k")).alias("removed")))


def drop_repeated_paragraphs(spark: SparkSession, docs: DataFrame, **params) -> DataFrame:
    """``docs`` with the removed paragraphs cut out of their texts (n_chars follows where it is there).

    Every row stays, also one that loses all its paragraphs; only white space and what stood between them is left of
    it then.  A cut belongs to a doc_id and a text, so another text of the same doc_id loses nothing.  Rows without a doc_id
    or text stay as they are.  All columns are kept, whatever their names.
    """
    cuts = (repeated_paragraphs(spark, docs, **params).where("removed").groupBy("doc_id", "th")
            .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts")))
    cuts = C.Scratch(spark, "cuts").save(cuts, "cuts")
    # the caller's columns travel in a struct of their own
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(cuts, ["doc_id", "th"], "left")
    # what is left: the stretches between the cuts
    text = F.expr("""array_join(transform(sequence(0, size(cuts)), i -> substring(row.text,
        int(if(i = 0, 0, cuts[i - 1].end)) + 1, int(if(i = size(cuts), length(row.text), cuts[i].start) - if(i = 0, 0, cuts[i - 1].end)))), '')""")
    out = out.withColumn("text", F.when(F.col("cuts").isNull(), F.col("row.text")).otherwise(text))

    def column(c: str):
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.when(F.col("cuts").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema[c].dataType)).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    return out.select(*[column(c) for c in docs.columns])
