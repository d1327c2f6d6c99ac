"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff, per-document scores.

    P(w | h) = d(c) * c(h, w) / (c(h) + 1)   if c(h, w) >= the smallest count kept
             = alpha(h) * P(w)               otherwise
    P(w)     = (1 - e) * d1(c) * c(w) / N for known words; the rest is the unknown word's, e = 1 / (N + V + 1)

c counts training documents only; d and d1 are Good-Turing ratios for counts up to
5 (Katz's formula); the one imaginary occurrence in c(h) + 1 leaves mass for unseen
words after histories whose pairs are all frequent; alpha(h) is
(1 - sum P(w | h)) / (1 - sum P(w)) over the words kept after h, so every
distribution sums to one over the known words and the unknown one.

The distinct (pair, document) occurrences are shuffled once, as compressed column
blocks keyed by a hash of the pair or, after a history that is not one of the HOT most
frequent words, of the history, so that such a history's count and alpha are found in
its partition.  The same shuffle output serves the counting, the sums per history and
the scoring; pairs are counted again in each of these and never written.  Counts of
the HOT words are broadcast; those of other words are joined and sent to the
partitions that have them.  Every partition adds up what its pairs give to the scores
of the documents of a run; known words and base scores of HOT words are added up before the shuffle.  Words and pairs are named by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sward.llm import common as C

#: Words with a place in the broadcast table; two-byte codes, 0 is left for all others.
HOT = 65_535
#: Tokens per column block of a mapper and per pair partition: bound a task's memory.
BLOCK_TOKENS, PARTITION_TOKENS = 1_000_000, 1_200_000
#: Rows of a written block.
BLOCK_ROWS = 1 << 17
#: Text hashed at once; the arrays of a pass take about 35 times as much.
SLICE_BYTES = 1 << 20
KATZ_K = 5
SPLIT, HELD_OUT = 7, 2
END, BEGIN = np.uint64(0xE4D0000000000001), np.uint64(0xBE61000000000001)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def token_arrays(column):
    """(token, history, row) of a batch of texts, the end of each text being a token."""
    data, off = C.string_buffers(column)
    h, row, _, _ = C.word_hashes(data, off)
    n = len(off) - 1
    tok = np.full(len(h) + n, END, dtype=np.uint64)
    tok[np.arange(len(h)) + row] = h
    cut = C.row_slices(row, n)
    where = np.repeat(np.arange(n), np.diff(cut) + 1)
    hist = np.empty_like(tok)
    hist[1:] = tok[:-1]
    hist[cut[:-1] + np.arange(n)] = BEGIN
    return tok, hist, where


def _count_words(batches):
    held, size = [], 0

    def flush():
        w, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(w), pa.array(c, pa.int64())], ["w", "c"])

    for b in C.slices(batches, data_bytes=SLICE_BYTES):
        held.append(token_arrays(b.column("text"))[0])
        size += len(held[-1])
        if size > 5 * BLOCK_TOKENS:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def good_turing(n: list[float], fallback: float = 0.5) -> np.ndarray:
    """Discount ratios for counts 0 .. KATZ_K + 1 from counts of counts n[1..KATZ_K + 1].

    Katz's formula; where it gives no ratio in (0, 1) (few data), (r - fallback) / r.
    """
    d = np.ones(KATZ_K + 2)
    d[0] = 0
    top = (KATZ_K + 1) * n[KATZ_K + 1] / n[1] if n[1] else 1.0
    for r in range(1, KATZ_K + 1):
        v = ((r + 1) * n[r + 1] / n[r] / r - top) / (1 - top) if n[r] and top < 1 else 0.0
        d[r] = v if 0 < v < 1 else (r - fallback) / r
    return d


class Unigrams:
    """P(w) and the base score from word counts; picklable constants of one training corpus."""

    def __init__(self, total: int, distinct: int, n: list[float], discounted: float | None = None):
        self.total, self.distinct = total, distinct
        self.d = good_turing(n)
        self.e = 1 / (total + distinct + 1)
        # discounted mass of known words, from the counts of counts
        lost = sum((1 - self.d[r]) * r * n[r] for r in range(1, KATZ_K + 1))
        self.unknown = (1 - self.e) * (lost / total) + self.e if total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        c = np.asarray(c, dtype=np.float64)
        ratio = self.d[np.minimum(c, KATZ_K + 1).astype(np.int64)]
        return np.where(c > 0, (1 - self.e) * ratio * c / max(self.total, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((np.asarray(c, dtype=np.float64) + 1) / (self.total + self.distinct + 1))


def _lookup(keys: np.ndarray, sorted_keys: np.ndarray):
    """(position, found) of keys in a sorted array."""
    if len(sorted_keys) == 0:
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    i = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return i, sorted_keys[i] == keys


# ------------------------------------------------------------------ pair blocks
def _coded(x: np.ndarray, code: np.ndarray):
    """Codes of words, and the words without one."""
    return code.tobytes(), x[code == 0].tobytes()


def _decoded(code: bytes, cold: bytes, hot: np.ndarray) -> np.ndarray:
    c = np.frombuffer(code, "<u2").astype(np.int64)
    out = np.empty(len(c), dtype=np.uint64)
    if len(hot):
        out[:] = hot[np.maximum(c - 1, 0)]
    out[c == 0] = np.frombuffer(cold, np.uint64)
    return out


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return C.mix64(h * _PAIR + w)


def _place(h: np.ndarray, t: dict):
    """(place, found) of histories in the table; BEGIN comes after the last word."""
    i, ok = _lookup(h, t["w"])
    begin = h == BEGIN
    return np.where(begin, len(t["w"]), i), ok | begin


def _small(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs; the first byte tells how many."""
    x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return bytes([x.itemsize]) + x.tobytes()


def _widened(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _blocks(parts: int, box, uni: Unigrams | None = None):
    """Rows (partition, run, block): distinct (pair, document) occurrences of a run of documents.

    A run is named by a hash of its documents' keys; one block per run lists those keys, the token numbers and,
    with ``uni``, how many of the tokens are words of the table and what these give to the base score.
    """
    def run(batches):
        import pickle

        import zstandard
        hot = box.value["w"]
        packer = zstandard.ZstdCompressor(level=1)
        held, size, rows = [], 0, 0

        def flush():
            tok, hist, doc, train, th = (np.concatenate([h[i] for h in held]) for i in range(5))
            ids = [x for h in held for x in h[5]]
            run_id = int(np.bitwise_xor.reduce(C.mix64(C.mix64(th.view(np.uint64)) + np.arange(len(th), dtype=np.uint64))
                                               + np.array([hash(x) & _MASK for x in ids], dtype=np.uint64)).view(np.int64))
            # a history is the token before it, so each token is looked up once
            i, ok = _lookup(tok, hot)
            code, begin = np.where(ok, i + 1, 0).astype("<u2"), hist == BEGIN
            before = np.zeros_like(code)
            before[1:] = code[:-1]
            before[begin] = 0
            listed = [ids, np.bincount(doc, minlength=len(ids)).astype("<i8").tobytes()]
            if uni:
                listed += [np.bincount(doc[ok], minlength=len(ids)).astype("<i8").tobytes(),
                           np.bincount(doc[ok], weights=uni.base(box.value["ch"])[i[ok]], minlength=len(ids)).tobytes()]
            key = pair_key(hist, tok)
            order = np.argsort(key, kind="stable")  # keeps the documents of a pair in order
            key, doc = key[order], doc[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(key)))
            key, doc, order = key[at], doc[at], order[at]
            whole = (before[order] == 0) & ~begin[order]  # histories that stay in one partition
            route = key.copy()
            route[whole] = C.mix64(hist[order[whole]] ^ _PAIR)
            part = ((route >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            by = np.argsort(part, kind="stable")
            key, doc, order, times, part = key[by], doc[by], order[by], times[by], part[by]
            edge = np.searchsorted(part, np.arange(parts + 1))
            out = []
            for p in range(parts):
                i, j = edge[p], edge[p + 1]
                if i == j:
                    continue
                k = key[i:j]
                head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                o = order[i:j][head]
                block = (*_coded(hist[o], before[o]), *_coded(tok[o], code[o]),
                         np.diff(np.append(head, j - i)).astype("<u4").tobytes(), doc[i:j].astype("<u4").tobytes(),
                         times[i:j].astype("<u4").tobytes(), np.packbits(train[doc[i:j]]).tobytes())
                out.append((p, b"P" + packer.compress(pickle.dumps(block))))
            out.append((run_id % parts, b"D" + packer.compress(pickle.dumps(listed))))
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([run_id] * len(out), pa.int64()),
                 pa.array([x[1] for x in out], pa.binary())], ["part", "run", "block"])

        for b in C.slices(batches, data_bytes=SLICE_BYTES):
            tok, hist, row = token_arrays(b.column("text"))
            held.append((tok, hist, row + rows, b.column("train").to_numpy(zero_copy_only=False),
                         b.column("th").to_numpy(), b.column("doc_id").to_pylist()))
            rows, size = rows + b.num_rows, size + len(tok)
            if size >= BLOCK_TOKENS:
                yield flush()
                held, size, rows = [], 0, 0
        if held:
            yield flush()
    return run


def _loaded(block: bytes) -> tuple:
    import pickle

    import zstandard
    return pickle.loads(zstandard.ZstdDecompressor().decompress(block[1:]))


def _unpack(loaded: tuple, hot: np.ndarray):
    """(history, token, documents per pair, document, times, is training document) of a block, the last three by occurrence."""
    hc, hx, wc, wx, n, doc, times, train = loaded
    doc = np.frombuffer(doc, "<u4").astype(np.int64)
    return (_decoded(hc, hx, hot), _decoded(wc, wx, hot), np.frombuffer(n, "<u4").astype(np.int64), doc,
            np.frombuffer(times, "<u4").astype(np.int64), np.unpackbits(np.frombuffer(train, np.uint8), count=len(doc)).astype(bool))


def _training_pairs(items, hot: np.ndarray, rare: list | None = None):
    """(key, history, token, count) of the distinct training pairs of one partition, in the order of their keys.

    ``rare`` gets the distinct words of each block that are not in the table.
    """
    hs, ws, cs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, block in items:
        if block[:1] == b"D":
            continue
        loaded = _loaded(block)
        if rare is not None:
            rare.append(np.unique(np.frombuffer(loaded[3], np.uint64)))
        h, w, n, _, times, train = _unpack(loaded, hot)
        total = np.add.reduceat(times * train, np.concatenate([[0], np.cumsum(n)[:-1]]))
        seen = total > 0
        hs.append(h[seen])
        ws.append(w[seen])
        cs.append(total[seen])
    h, w, c = np.concatenate(hs), np.concatenate(ws), np.concatenate(cs)
    key = pair_key(h, w)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    c = np.add.reduceat(c[order], at) if len(at) else c
    return key[at], h[order[at]], w[order[at]], c


def _columns(*arrays) -> list[bytes]:
    """Columns of 64 bits, cut to a bounded size."""
    x = np.stack([np.ascontiguousarray(a).view(np.uint64) for a in arrays])
    return [x[:, i:i + BLOCK_ROWS].tobytes() for i in range(0, x.shape[1], BLOCK_ROWS)]


def _count_pairs(box):
    """(part, n, block) of one partition: counts of counts, and its words that are not in the table."""
    def run(part, items):
        rare = [np.zeros(0, np.uint64)]
        c = _training_pairs(items, box.value["w"], rare)[3]
        yield (part, [int((c == r).sum()) for r in range(1, KATZ_K + 2)], None)
        for block in _columns(np.unique(np.concatenate(rare))):
            yield (part, None, block)
    return run


def _word_counts(w: np.ndarray, counts: tuple, t: dict) -> np.ndarray:
    """c(w): from the table, from the sorted (words, counts) of the partition, or 0."""
    i, ok = _lookup(w, t["w"])
    out = np.zeros(len(w), dtype=np.int64)
    out[ok] = t["ch"][i[ok]]
    if not ok.all() and len(counts[0]):
        i, seen = _lookup(w[~ok], counts[0])
        out[~ok] = np.where(seen, counts[1][i], 0)
    return out


def _sorted_counts(blocks) -> tuple:
    x, n = np.concatenate([np.zeros((2, 0), np.uint64)] + [np.frombuffer(b, np.uint64).reshape(2, -1) for b in blocks], axis=1)
    order = np.argsort(x)
    return x[order], n[order].view(np.int64)


def _model(blocks, counts, t: dict, least: int, d: np.ndarray, uni: Unigrams):
    """The model's pairs in one partition: key, P(w | h); its histories outside the table; sums of P(w | h) and P(w) per history.

    A history outside the table has all its pairs here, so they add up to its count.
    """
    key, h, w, c = _training_pairs(blocks, t["w"])
    at, ok = _place(h, t)
    cold, of = np.unique(h[~ok], return_inverse=True)
    table = len(t["ch"])
    at[~ok] = table + of
    ch = np.concatenate([t["ch"], np.bincount(of, weights=c[~ok], minlength=len(cold))])[at]
    kept = c >= least
    key, w, c, at, ch = key[kept], w[kept], c[kept], at[kept], ch[kept]
    p = d[np.minimum(c, KATZ_K + 1)] * c / (ch + 1)
    p1 = uni.p(_word_counts(w, counts, t))
    sums = [np.bincount(at, weights=x, minlength=table + len(cold)) for x in (p, p1)]
    return key, p, cold, *sums  # the table, BEGIN, then the others


def _history_sums(box, *model):
    """Sums of P(w | h) and P(w) of the table's histories over one partition (blocks of h, sp, s1)."""
    def run(item):
        t = box.value
        *_, sp, s1 = _model(item[0], _sorted_counts(item[1]), t, *model)
        at = np.flatnonzero(sp[:len(t["ch"])])
        for block in _columns(np.append(t["w"], BEGIN)[at], sp[at], s1[at]):
            yield (0, None, block)
    return run


def _score_pairs(box, least: int, d: np.ndarray, uni: Unigrams):
    """(run, block) of one partition: documents of a run that have some of its pairs, their scores, and of those with words that
    are not in the table how many of these are known and their base (b"S"), and what is listed there of runs (b"D")."""
    def run(item):
        import pickle

        blocks, counts = item
        t, counts = box.value, _sorted_counts(counts)
        key, p, cold, sp, s1 = _model(blocks, counts, t, least, d, uni)
        log_p, table = np.log10(p), len(t["ch"])
        cold_la = np.log10((1 - sp[table:]) / (1 - s1[table:])) if len(cold) else np.zeros(1)
        for _, run_id, block in blocks:
            if block[:1] == b"D":
                yield (run_id, bytes(block))
                continue
            loaded = _loaded(block)
            h, w, n, doc, times, _ = _unpack(loaded, t["w"])
            # places in the table are the block's codes
            code = np.frombuffer(loaded[2], "<u2").astype(np.int64)
            rare = code == 0
            c = t["ch"][code - 1]
            c[rare] = _word_counts(w[rare], counts, t)
            code = np.frombuffer(loaded[0], "<u2").astype(np.int64)
            la = t["la"][code - 1]  # code 0: the last place, BEGIN's
            other = np.flatnonzero((code == 0) & (h != BEGIN))
            j, ok = _lookup(h[other], cold)
            la[other] = np.where(ok, cold_la[j], 0.0)
            score = la + np.log10(uni.p(c))
            i, ok = _lookup(pair_key(h, w), key)
            score[ok] = log_p[i[ok]]
            docs, at = np.unique(doc, return_inverse=True)  # those that have one of the pairs
            score = np.bincount(at, weights=np.repeat(score, n) * times)
            c, of = c[rare], np.repeat(rare, n)
            some, at = np.unique(doc[of], return_inverse=True)
            known, base = (np.bincount(at, weights=np.repeat(x, n[rare]) * times[of]) for x in (c > 0, uni.base(c)))
            yield (run_id, b"S" + pickle.dumps((_small(np.diff(docs, prepend=0)), score.tobytes(),
                                                _small(np.diff(some, prepend=0)), _small(known), base.tobytes())))
    return run


def _documents(batches):
    """One row per document from the blocks of its run; a run that is there more than once, once for each."""
    import pickle

    import zstandard
    runs: dict[int, list] = {}
    for b in batches:
        for r, block in zip(b.column("run").to_pylist(), b.column("block")):
            block = block.as_py()
            ids, size, copies, total = runs.setdefault(r, [None, None, 0, np.zeros((3, 0))])
            if block[:1] == b"D":
                ids, size, known, base = pickle.loads(zstandard.ZstdDecompressor().decompress(block[1:]))
                docs = some = np.arange(len(ids))
                known, score = np.frombuffer(known, "<i8"), np.zeros(len(ids))
                runs[r][:3] = [ids, np.frombuffer(size, "<i8"), copies + 1]
            else:
                docs, score, some, known, base = pickle.loads(block[1:])
                docs, some, known = np.cumsum(_widened(docs)), np.cumsum(_widened(some)), _widened(known)
                score = np.frombuffer(score)
            most = int(docs[-1]) + 1 if len(docs) else 0  # in ascending order, and some are among them
            if most > total.shape[1]:
                total = runs[r][3] = np.pad(total, ((0, 0), (0, max(most, 2 * total.shape[1]) - total.shape[1])))
            for have, at, more in zip(total, (some, some, docs), (known, np.frombuffer(base), score)):
                have[at] += more
    for ids, size, copies, total in runs.values():
        total = np.pad(total, ((0, 0), (0, max(0, len(ids) - total.shape[1]))))[:, :len(ids)] / copies
        for _ in range(copies):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(np.rint(total[0]).astype(np.int64)),
                 pa.array(total[1]), pa.array(total[2])], ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def score_documents(spark: SparkSession, docs: DataFrame, *, least: int = 1) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (runs of bytes other than space and 0x09-0x0D, A-Z
    lower-cased) and one end per text; a NULL text is an empty one, and has the end
    token only.  The model learns from rows whose crc32(doc_id) modulo 7 is not 2
    (a NULL doc_id counts as held out, is scored and never learned from).
    Every training pair is in the model; with ``least`` above 1, pairs of fewer occurrences count as unseen (Katz's option).
    base_score sums log10((c + 1) / (N + V + 1)); score is the model's log10 probability.  Repeated rows
    are counted and scored as often as they occur.  Without training rows every
    token is the unknown word with probability 1.  Other columns are ignored.
    """
    scratch = C.Scratch(spark, "katz")
    train = F.coalesce(C.crc_bucket(F.col("doc_id"), SPLIT) != HELD_OUT, F.lit(False))
    # a document's id and a hash of its text name the run it is in
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"),
                       train.alias("train"), "text")
    words = scratch.save(rows.where("train").select("text").mapInArrow(C.releasing(_count_words, first=True), "w long, c long")
                         .groupBy("w").agg(F.sum("c").alias("c")), "words")
    cc = [F.count(F.when(F.col("c") == r, 1)).alias(f"n{r}") for r in range(1, KATZ_K + 2)]
    got = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), *cc).first()
    uni = Unigrams(int(got[0]), int(got[1]), [0, *got[2:]])
    texts = words.where(F.col("w") == int(END.view(np.int64))).select("c").first()
    n_texts = texts[0] if texts else 0
    top = words.orderBy(F.desc("c"), "w").limit(HOT).toArrow()  # bounded by HOT
    hot_w = top.column("w").to_numpy().view(np.uint64)
    hot_c = top.column("c").to_numpy()
    order = np.argsort(hot_w)
    hot_w, hot_c = hot_w[order], hot_c[order]
    sc = spark.sparkContext
    # c(h) by place: the words, then BEGIN
    hot = {"w": hot_w, "ch": np.append(hot_c, n_texts).astype(np.int64)}
    box = sc.broadcast(hot)
    parts = max(1, math.ceil(uni.total * 1.2 / PARTITION_TOKENS))

    blocks = rows.mapInArrow(C.releasing(_blocks(parts, box, uni), first=True), "part int, run long, block binary").repartitionById(parts, "part").rdd  # read three times, shuffled once
    form = "part int, n array<long>, block binary"
    counted = scratch.save(spark.createDataFrame(blocks.mapPartitionsWithIndex(C.releasing(_count_pairs(box), first=True)), form, verifySchema=False), "counted")
    n = counted.agg(*[F.coalesce(F.sum(F.col("n")[r]), F.lit(0)) for r in range(KATZ_K + 1)]).first()
    d = good_turing([0, *n])

    # counts of the words that are not in the table, for the partitions that have them
    def wanted(batches):
        for b in batches:
            for p, x in zip(b.column("part").to_pylist(), b.column("block").to_pylist()):
                w = np.frombuffer(x, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), p, np.int32)), _signed(w)], ["part", "w"])

    def sent(batches):
        held, size = [], 0

        def flush():
            p, w, c = (np.concatenate([h[i] for h in held]) for i in range(3))
            order = np.argsort(p, kind="stable")
            to, at = np.unique(p[order], return_index=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), pa.array([np.stack([w[o], c[o]]).tobytes() for o in np.split(order, at[1:])], pa.binary())],
                ["part", "block"])

        for b in batches:
            held.append([b.column(c).to_numpy() for c in ("part", "w", "c")])
            size += b.num_rows
            if size >= BLOCK_ROWS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    rare = counted.where("block is not null").select("part", "block").mapInArrow(wanted, "part int, w long").join(words, "w")
    rare = scratch.save(rare.select("part", "w", "c").mapInArrow(sent, "part int, block binary"), "rare")
    scratch.drop(words, counted)
    rare = rare.repartitionById(parts, "part").rdd
    both = (blocks.mapPartitions(lambda it: [list(it)])
            .zip(rare.mapPartitions(lambda it: [[bytes(x[1]) for x in it]])))
    model = (least, d, uni)

    # the sums per history that make alpha(h)
    def unblocked(batches):
        for b in batches:
            for x in b.column("block").to_pylist():
                h, sp, s1 = np.frombuffer(x, np.uint64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([_signed(h), pa.array(sp.view(np.float64)), pa.array(s1.view(np.float64))],
                                                 ["h", "p", "p1"])

    sums = spark.createDataFrame(both.flatMap(C.releasing(_history_sums(box, *model), first=True)), form, verifySchema=False)
    hist = (sums.select("block").mapInArrow(unblocked, "h long, p double, p1 double")
            .groupBy("h").agg(F.sum("p").alias("sp"), F.sum("p1").alias("s1")))
    # both masses are positive: the unknown word has some in P(w), and c(h) + 1 leaves some after h
    alpha = scratch.save(hist.select("h", F.log10((1 - F.col("sp")) / (1 - F.col("s1"))).alias("la")), "alpha").toArrow()  # bounded by HOT

    la = np.zeros(len(hot_w) + 1)
    la[_place(alpha.column("h").to_numpy().view(np.uint64), hot)[0]] = alpha.column("la").to_numpy()
    table = sc.broadcast({**hot, "la": la})

    scores = spark.createDataFrame(both.flatMap(C.releasing(_score_pairs(table, *model), first=True)), "run long, block binary", verifySchema=False)
    out = scores.repartition("run").mapInArrow(
        C.releasing(_documents, first=True), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (~F.coalesce(C.crc_bucket(F.col("doc_id"), SPLIT) != HELD_OUT, F.lit(False))).alias("held_out"),
                      "n_tokens", "n_known", F.lit(int(uni.total)).alias("train_tokens"), "base_score", "score")
