"""Packing documents into training sequences by multiway differencing (Karmarkar-Karp).

Each task tokenises its own documents and packs them in blocks, so token ids
never cross the network.  A document longer than a sequence is cut into full
sequences; what is left over is cut into pieces, and a block of pieces is
partitioned into windows by differencing: every piece starts as a partition
(size, 0, ..., 0), the two partitions with the largest imbalance are merged, the
fullest window of one with the emptiest of the other, until one is left.  If a
window exceeds the capacity, the window count rises and the block is packed anew.
"""

from __future__ import annotations

import heapq
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sward.llm.common import releasing, slices, string_buffers

CAPACITY = 4096
END_ID = 2
#: Leftovers are cut into equal pieces of at most this many tokens, so that windows can be levelled.
MAX_PIECE = 512
#: Pieces per block: bounds the memory of a task (pieces x windows small integers) and its time.
BLOCK_PIECES = 4000
#: Entries of a worker's chunk cache, and of one that goes with its task; it is emptied when full.
CACHE_ENTRIES, TASK_ENTRIES = 1_200_000, 100_000
#: A cache is full as well when it holds this many bytes for each entry allowed (an English word and its ids: some 40).
ENTRY_BYTES = 100
#: Texts encoded at once where the cache goes with the task.
TASK_TEXTS = 128
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window number of every size, by multiway differencing."""
    n = len(sizes)
    if windows <= 1:
        return np.zeros(n, np.int64)
    kind = np.uint16 if windows < 65536 else np.uint32
    node = {}
    heap = []
    for i, s in enumerate(sizes.tolist()):
        v = np.zeros(windows, np.int32)
        v[0] = s
        node[i] = v
        heap.append((-s, i))
    heapq.heapify(heap)
    merged = {}
    nxt = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = node.pop(a) + node.pop(b)[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        total -= total[-1]
        merged[nxt] = (a, b, order.astype(kind))
        node[nxt] = total
        heapq.heappush(heap, (-int(total[0]), nxt))
        nxt += 1
    out = np.zeros(n, np.int64)
    label = {heap[0][1]: np.arange(windows)}
    for m in range(nxt - 1, n - 1, -1):  # hand the window names down to the pieces
        a, b, order = merged.pop(m)
        mine = label.pop(m)
        la = np.empty(windows, np.int64)
        la[order] = mine
        label[a], label[b] = la, la[::-1]
        for x in (a, b):
            if x < n:
                out[x] = label.pop(x)[0]
    if n == 1:
        out[0] = 0
    return out


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window number of every size so that no window exceeds ``capacity``."""
    total = int(sizes.sum())
    windows = max(1, -(-total // capacity))
    while True:
        out = difference(sizes, windows)
        if np.bincount(out, weights=sizes, minlength=windows).max() <= capacity:
            return out
        windows = max(windows + 1, min(len(sizes), windows + windows // 400))


#: ASCII marks that begin a token behind an ASCII letter or digit; an apostrophe may begin "'s" and the like.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Keeps its case: a special token, and characters that may combine with a letter (the tokenizer composes, then folds).
_CASED = "<\\||[^\\x00-\\x{2ff}]"


class _Known:
    """Encoded chunks and their ids, as Arrow arrays."""

    def __init__(self):
        self.clear()

    def __len__(self):
        return len(self.chunks)

    def clear(self):
        self.chunks, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def full(self, entries: int) -> bool:
        return len(self) > entries or self.chunks.nbytes + self.ids.nbytes > entries * ENTRY_BYTES

    def add(self, chunks: pa.Array, ids: pa.Array):
        self.chunks, self.ids = pa.concat_arrays([self.chunks, chunks]), pa.concat_arrays([self.ids, ids])


#: (path, tokenizer, known chunks, special token between chunks or None) of this worker process; the next task goes on with it.
_STATE: list = []


def _tokenizer(path: str) -> tuple:
    if not _STATE or _STATE[0] != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        special = [(t.content, i) for i, t in tokenizer.get_added_tokens_decoder().items()
                   if t.special and t.content.startswith("<|") and not (t.lstrip or t.rstrip or t.single_word)]
        _STATE[:] = [path, tokenizer, _Known(), min(special, default=None)]
    return _STATE[1:]


def _chunks(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """The unlike words of texts, the word at each place by its number, and where each text's places begin, with the end.

    The tokenizer drops white space and never joins what white space separates, so a text may be
    cut at blanks and equal words are encoded once.
    """
    words = pc.ascii_split_whitespace(texts)
    cut = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False), out=cut[1:])
    places = words.flatten().dictionary_encode()
    return places.dictionary.cast(pa.large_string()), places.indices, cut


def _parts(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each word, folded where it is sure that the tokenizer would do so, without its last marks; and those marks.

    Marks stay with a word where they might share a token with what is before them.
    """
    cased = pc.match_substring_regex(words, _CASED)
    words = pc.if_else(cased, words, pc.ascii_lower(words))
    stems = pc.ascii_rtrim(words, _MARKS)
    cut = pc.and_(pc.not_equal(stems, words), pc.match_substring_regex(stems, "[A-Za-z0-9]$"))
    cut = pc.and_(cut, pc.invert(pc.match_substring(words, "<|")))
    marks = pc.replace_substring_regex(words.filter(cut), "^(?s:.*)[A-Za-z0-9]", "")
    none = pa.repeat(pa.scalar("", pa.large_string()), len(words))
    return pc.if_else(cut, stems, words), pc.replace_with_mask(none, cut, marks)


def _new_ids(chunks: list[str], tokenizer, special: tuple | None) -> pa.Array:
    """The little-endian uint32 ids of each chunk.

    A special token splits a text before anything else is done, so many chunks with one between
    them are encoded in one call.  Chunks that might hold a special token are encoded alone.
    """
    data, sizes = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]

    def alone(some):
        for e in tokenizer.encode_batch_fast(some, add_special_tokens=False):
            data.append(np.array(e.ids, dtype="<u4"))
            sizes.append([len(data[-1])])

    for at in range(0, len(chunks), 1024):
        part = chunks[at:at + 1024]
        if special is None or any("<|" in c for c in part):
            alone(part)
            continue
        text, number = special
        ids = np.array(tokenizer.encode_batch_fast([text.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
        between = ids == number
        ends = np.flatnonzero(between)
        if len(ends) != len(part) - 1:
            alone(part)
            continue
        data.append(ids[~between])
        sizes.append(np.diff(ends, prepend=-1, append=len(ids)) - 1)
    offsets = 4 * np.cumsum(np.concatenate(sizes))
    return pa.Array.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(data))])


def _encode(texts: pa.Array, tokenizer, known: _Known, special: tuple | None = None, entries: int = CACHE_ENTRIES):
    """Little-endian uint32 ids of each text, the end id included."""
    words, places, cut = _chunks(texts)
    chunks = pa.concat_arrays(_parts(words)).dictionary_encode()
    if known.full(entries):
        known.clear()
    at = pc.index_in(chunks.dictionary, value_set=known.chunks)
    unknown = pc.is_null(at)
    new = chunks.dictionary.filter(unknown)
    if len(new):
        at = pc.replace_with_mask(at, unknown, pa.array(np.arange(len(known), len(known) + len(new), dtype=np.int32)))
        # those that might hold a special token come last, so that few others are encoded alone
        order = np.argsort(pc.match_substring(new, "<|").to_numpy(zero_copy_only=False), kind="stable")
        ids = _new_ids(new.to_numpy(zero_copy_only=False)[order].tolist(), tokenizer, special)
        known.add(new, ids.take(pa.array(np.argsort(order))))
    ids = known.ids.take(at)
    stems, marks = chunks.indices[:len(words)], chunks.indices[len(words):]
    ids = pc.binary_join_element_wise(ids.take(stems), ids.take(marks), pa.scalar(b"", pa.large_binary()))
    data, at = string_buffers(ids.take(places))
    end = np.asarray([END_ID], dtype="<u4").tobytes()
    at = at[cut].tolist()
    return [data[i:j].tobytes() + end for i, j in zip(at, at[1:])]


def _pack_rows(path: str, capacity: int, max_piece: int, block_pieces: int, keep_cache: bool = True):
    def run(batches):
        tokenizer, cache, special = _tokenizer(path)
        seq = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: list[tuple] = []

        def encoded(column):
            step, entries = (len(column), CACHE_ENTRIES) if keep_cache else (TASK_TEXTS, TASK_ENTRIES)
            for at in range(0, len(column), step):
                yield from _encode(column.slice(at, step), tokenizer, cache, special, entries)

        def emit(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                              ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def block():
            nonlocal seq
            window = pack(np.array([p[2] for p in held], dtype=np.int64), capacity)
            fill = [0] * (int(window.max()) + 1)
            rows = []
            for p, w in zip(held, window.tolist()):
                rows.append((*p, seq + w, fill[w]))
                fill[w] += p[2]
            # only windows that hold something get a number
            names = {w: i for i, w in enumerate(sorted(set(window.tolist())))}
            rows = [(*r[:5], seq + names[r[5] - seq], r[6]) for r in rows]
            seq += len(names)
            held.clear()
            return rows

        for b in slices(batches, rows=8192, data_bytes=8 << 20):
            out = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoded(b.column("text"))):
                n = len(ids) // 4
                full = n // capacity
                for i in range(full):
                    out.append((doc, i * capacity, capacity, zlib.crc32(ids[4 * i * capacity:4 * (i + 1) * capacity]), n, seq, 0))
                    seq += 1
                at, rest = full * capacity, n - full * capacity
                parts = -(-rest // max_piece)
                for i in range(parts):
                    size = rest // parts + (i < rest % parts)
                    held.append((doc, at, size, zlib.crc32(ids[4 * at:4 * (at + size)]), n))
                    at += size
                if len(held) >= block_pieces:
                    out += block()
            if out:
                yield emit(out)
        if held:
            yield emit(block())
        if not keep_cache:
            cache.clear()  # the tokenizer stays: every one that has encoded leaves some MB behind when it goes
    return run if keep_cache else releasing(run, first=True)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY,
                   max_piece: int = MAX_PIECE, block_pieces: int = BLOCK_PIECES, keep_cache: bool = True) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text).

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  NULL and
    empty texts are the end id alone.  Rows repeated or without a doc_id are packed
    like any other.  An empty table gives no row; other columns are ignored.
    Sequence numbers are the task's partition number times 2**40 plus a count, so
    a task that is run again gives the same rows.  ``keep_cache``: a worker's encoded chunks
    stay for its next task; without it they go with the task, and are fewer, for jobs that do other work in the same workers.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_pack_rows(tokenizer_path, capacity, max_piece, block_pieces, keep_cache), SCHEMA)
