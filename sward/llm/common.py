"""Helpers shared by the operators of this package.

* ``Scratch``: written intermediate tables in the shared folder (lineage cuts).
* word hashing on whole Arrow batches with numpy (no per-word Python work).
* the crc32 split that separates training from held-out documents.
"""

from __future__ import annotations

import ctypes
import gc
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from sward.session import ensure_checkpoint_dir


#: Whether Spark deletes the shuffle files of an action when it ends; else they stay until the driver's next garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written under the session's ``spark.checkpoint.dir``.

    A written table cuts the lineage: a lost executor costs a re-read, never a
    recomputation of everything before it.  The shuffle files that it was made
    from go when it is written.  ``drop`` removes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = os.path.join(ensure_checkpoint_dir(spark), f"llm-{name}-{uuid.uuid4().hex[:12]}")
        self._n = 0
        self._paths: dict[int, str] = {}

    def save(self, df: DataFrame, label: str = "t", files: int | None = None) -> DataFrame:
        """Write ``df`` and return the table read back; ``files`` coalesces small results."""
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{label}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            (df.coalesce(files) if files else df).write.mode("overwrite").parquet(path)
        finally:  # the session's own setting
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                delete_path(self.spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder this package wrote, on whatever file system holds it."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_bucket(doc_id, modulus: int):
    """crc32 of the id's decimal text modulo ``modulus`` (a NULL id gives NULL)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


# ------------------------------------------------------------------ word hashing
_RNG = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Word separators: space and the controls 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE[SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POW = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection on 64-bit integers (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x = x * _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        size = max(n, 2 * len(_POW), 1 << 12)
        p = np.full(size, _BASE, dtype=np.uint64)
        p[0] = 1
        _POW = np.cumprod(p, dtype=np.uint64)
    return _POW


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column (NULL counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """64-bit hash of every word of a batch of texts.

    Returns (hash, row, start, end): words are maximal runs of bytes other than
    space and 0x09-0x0D inside one row; A-Z are lower-cased first.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n == 0:
        return np.zeros(0, np.uint64), none, none, none
    d = _LOWER[data] if lower else data
    word = ~SPACE[d]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = word[heads]
    start = np.flatnonzero(first)
    if len(start) == 0:
        return np.zeros(0, np.uint64), none, none, none
    last = word.copy()
    last[:-1] &= ~word[1:]
    tails = heads[1:] - 1
    last[tails] |= word[tails]
    end = np.flatnonzero(last) + 1
    seg = np.diff(np.append(start, n))
    at = np.arange(start[0], n) - np.repeat(start, seg)
    values = _BYTE[d[start[0]:]] * _powers(int(seg.max()) + 1)[at]
    h = mix64(np.add.reduceat(values, start - start[0]) + (end - start).astype(np.uint64))
    row = np.searchsorted(offsets, start, side="right") - 1
    return h, row, start, end


_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct sorted hashes of the k-word shingles of one text.

    With fewer than k words the whole sequence is one shingle; without words
    the set is empty.
    """
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    s = mix64(words[:n - k + 1] + np.uint64(k))
    for j in range(1, k):
        s = mix64(s * _STEP + words[j:n - k + 1 + j])
    return np.unique(s)


def shingle_sets(words: np.ndarray, cut: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_hashes`` of every group of words at once.

    ``cut`` holds the start of each group and the end of the last.  Returns the
    sets one after the other, each sorted and distinct, and their offsets.
    """
    groups = len(cut) - 1
    size = np.diff(cut)
    group = np.repeat(np.arange(groups), size)
    s = mix64(words + np.uint64(k))
    for j in range(1, min(k, len(words))):
        s[:len(s) - j] = mix64(s[:len(s) - j] * _STEP + words[j:])
    whole = np.arange(len(words)) + k <= cut[1:][group]
    s, g = s[whole], group[whole]
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        s = np.concatenate([s, *[shingle_hashes(words[cut[i]:cut[i + 1]], k) for i in short]])
        g = np.concatenate([g, short])
    order = np.lexsort((s, g))
    s, g = s[order], g[order]
    if len(s):
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (g[1:] != g[:-1])
        s, g = s[new], g[new]
    return s, np.searchsorted(g, np.arange(groups + 1))


def row_slices(row: np.ndarray, n_rows: int) -> np.ndarray:
    """Start of each row's words in a row-sorted word array (length n_rows + 1)."""
    return np.searchsorted(row, np.arange(n_rows + 1))


def set_digest(values: np.ndarray) -> bytes:
    """16-byte digest of a set given as its sorted distinct hashes."""
    import xxhash
    return xxhash.xxh3_128_digest(np.ascontiguousarray(values).tobytes())


def list_array(parts: list[np.ndarray]) -> pa.Array:
    """Arrow list column from one numpy array per row."""
    off = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    return flat_list(np.concatenate(parts) if off[-1] else np.zeros(0, np.uint64), off)


def flat_list(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow list column from the rows' values one after the other."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)),
                                    pa.array(np.ascontiguousarray(values).view(np.int64)))


def release_memory() -> None:
    """Give memory that was freed back to the system: Python's (collecting empties its lists of spare objects, which
    hold whole blocks of memory), Arrow's pool, then the C heap where it is glibc's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own rules
        pass


def releasing(run, first: bool = False):
    """``run``, a generator function of a task; what it freed leaves the Python worker, which outlives the task, when it ends.

    ``first``: what the task before it left does so too, before it begins.
    """
    def wrapped(*args):
        if first:
            release_memory()
        try:
            yield from run(*args)
        finally:
            release_memory()
    return wrapped


def slices(batches, rows: int = 4096, data_bytes: int = 6 << 20, text: str = "text"):
    """Cut Arrow batches so that one piece holds a bounded amount of text (a text is never cut)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            to = int(np.searchsorted(size, base + data_bytes, side="right"))
            to = min(max(to, at + 1), at + rows, b.num_rows)
            yield b.slice(at, to - at)
            at = to
