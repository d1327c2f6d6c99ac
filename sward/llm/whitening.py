"""Embedding whitening from exact integer second moments (bit-sliced scatter).

Vectors become integers x = floor(scale * c).  Each distinct vector counts once.  A
task packs its vectors in blocks: every dimension is shifted to start at 0 in the
block and its bit planes are packed across the rows into 64-bit words.  The sum of
u_i * u_j is then the sum over planes a of i and b of j of 2**(a + b) times the popcount
of (plane a AND plane b), an integer.  Shifts are taken back in integers, blocks and
tasks add up exactly, and n * sum(x x') - S S' is centred as integers before it is
divided and given to ``eigh``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from sward.llm import common as C

SCALE = 256
COMPONENTS = 4
#: Vector entries of a block (bounds a task's memory) and its most rows.
BLOCK_ENTRIES, BLOCK_ROWS = 1 << 20, 1 << 14
#: Eigenvalues up to this share of the trace count as zero: no component.
MIN_SHARE = 1e-12
#: Sums travel as signed limbs of so many bits.
LIMB_BITS, LIMBS = 40, 4
_WIDTHS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}


def integer_vectors(column, scale: float, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, x as int64 rows) of the vectors that take part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy().astype(np.int64)
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(off) == dims)
    rows = np.flatnonzero(whole)
    values = pc.fill_null(column.values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    if len(rows) == 0:
        return rows, np.zeros((0, dims), np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * values[off[rows][:, None] + np.arange(dims)])
        ok = (np.abs(x) < 2.0 ** 63).all(axis=1)  # false for NaN and infinity too
    return rows[ok], x[ok].astype(np.int64)


def _packed(scale: float, dims: int):
    """Distinct vectors of a batch as bytes: the narrowest integers that hold all entries of the vector."""
    def run(batches):
        for b in batches:
            _, x = integer_vectors(b.column("v"), scale, dims)
            if len(x) == 0:
                continue
            top = np.maximum(x.max(axis=1), ~x.min(axis=1))  # ~x = -x - 1
            for width, kind in _WIDTHS.items():
                narrower = top >> (4 * width - 1) != 0 if width > 1 else True
                mine = x[(top >> (8 * width - 1) == 0) & narrower] if width < 8 else x[narrower]
                if len(mine):
                    flat = np.ascontiguousarray(mine.astype(kind))
                    off = np.arange(len(mine) + 1, dtype=np.int32) * (width * dims)
                    yield pa.RecordBatch.from_arrays(
                        [pa.Array.from_buffers(pa.binary(), len(mine), [None, pa.py_buffer(off), pa.py_buffer(flat)])], ["x"])
    return run


def _unpacked(column, dims: int) -> np.ndarray:
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    parts = [np.zeros((0, dims), np.int64)]
    for width, kind in _WIDTHS.items():
        mine = column.filter(pa.array(size == width * dims))
        if len(mine):
            data, _ = C.string_buffers(mine)
            parts.append(data.view(kind).reshape(-1, dims).astype(np.int64))
    return np.concatenate(parts)


def bit_planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowest value of each dimension, planes as rows of 64-bit words, dimension and bit of each plane)."""
    lo = x.min(axis=0)
    u = x.view(np.uint64) - lo.view(np.uint64)  # exact modulo 2**64
    pad = -len(x) % 64
    if pad:
        u = np.concatenate([u, np.zeros((pad, u.shape[1]), np.uint64)])
    top = u.max(axis=0)
    planes, dim, bit = [], [], []
    for b in range(int(top.max()).bit_length()):
        has = np.flatnonzero(top >> np.uint64(b))
        on = ((u[:, has] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        planes.append(np.ascontiguousarray(np.packbits(on, axis=0).T).view(np.uint64))
        dim.append(has)
        bit.append(np.full(len(has), b))
    if not planes:
        return lo, np.zeros((0, len(u) // 64), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return lo, np.concatenate(planes), np.concatenate(dim), np.concatenate(bit)


def scatter(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, sums of products) of integer rows, exact Python integers."""
    n, d = x.shape
    lo, planes, dim, bit = bit_planes(x)
    exact = int(bit.max(initial=0)) * 2 + 2 + n.bit_length() < 62
    kind = np.int64 if exact else object
    products, sums = np.zeros((d, d), kind), np.zeros(d, kind)
    weight = np.array([1 << int(b) for b in bit], dtype=kind)
    both, ones = np.empty_like(planes), np.empty(planes.shape, np.uint8)
    for p in range(len(planes)):
        k = len(planes) - p
        np.bitwise_and(planes[p:], planes[p], out=both[:k])
        np.bitwise_count(both[:k], out=ones[:k])
        count = ones[:k].sum(axis=1, dtype=np.int64).astype(kind) * weight[p:] * weight[p]
        i = dim[p]
        sums[i] += count[0] // weight[p]  # a plane AND itself is the plane
        np.add.at(products[i], dim[p:], count)
        np.add.at(products[:, i], dim[p + 1:], count[1:])
    lo, sums, products = lo.astype(object), sums.astype(object), products.astype(object)
    products = products + np.outer(lo, sums) + np.outer(sums, lo) + n * np.outer(lo, lo)
    return n, sums + n * lo, products


def _limbs(values: list[int]) -> list[pa.Array]:
    mask = (1 << LIMB_BITS) - 1
    return [pa.array([(abs(v) >> (LIMB_BITS * k) & mask) * (1 if v >= 0 else -1) for v in values], pa.int64())
            for k in range(LIMBS)]


_LIMB_NAMES = [f"l{k}" for k in range(LIMBS)]


def _moments(dims: int, block: int):
    """Of a task, (i, j, limbs): sums of products for i <= j, sums at j = -1, the row count at i = -1."""
    def run(batches):
        total = [0, np.zeros(dims, object), np.zeros((dims, dims), object)]

        def add(x):
            for at, more in enumerate(scatter(x)):
                total[at] = total[at] + more

        held, size = [], 0
        for b in batches:
            held.append(_unpacked(b.column("x"), dims))
            size += len(held[-1])
            if size >= block:
                x = np.concatenate(held)
                whole = size // block * block
                for at in range(0, whole, block):
                    add(x[at:at + block])
                held, size = [x[whole:]], size - whole
        if size:
            add(np.concatenate(held))
        if total[0]:
            i, j = np.triu_indices(dims)
            values = [total[0], *total[1], *total[2][i, j]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([[-1], np.arange(dims), i]).astype(np.int32)),
                 pa.array(np.concatenate([[-1], np.full(dims, -1), j]).astype(np.int32)), *_limbs([int(v) for v in values])],
                ["i", "j", *_LIMB_NAMES])
    return run


class Whitener:
    """Mean, scaled components and shares of one fit list; picklable, of a size bounded by the dimensions."""

    def __init__(self, n: int, sums: list[int], products: dict, components: int):
        self.n, self.sums, self.dims = n, sums, len(sums)
        v = np.empty((self.dims, self.dims))
        for (i, j), s in products.items():
            v[i, j] = v[j, i] = (n * s - sums[i] * sums[j]) / (n * n)  # integers until the division
        e, w = np.linalg.eigh(v)
        trace = float(np.trace(v))
        keep = [k for k in range(self.dims - 1, -1, -1) if e[k] > MIN_SHARE * trace][:components]
        self.mean = np.array([s / n for s in sums])
        self.axes = w[:, keep] / np.sqrt(e[keep])
        self.explained = [float(e[k] / trace) for k in keep]

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)**2, exact; None where it does not fit a long."""
        n, s = self.n, self.sums
        high = max(1, int(np.abs(x).max(initial=0)))
        most = max(1, max(map(abs, s)))
        if self.dims * (n * high + most) ** 2 < 1 << 63:
            gap = n * x - np.array(s, np.int64)
            return (gap * gap).sum(axis=1).tolist()
        if self.dims * high * max(high, most) >= 1 << 63:
            x = x.astype(object)
        square = (x * x).sum(axis=1).tolist()
        cross = (x * np.array(s, x.dtype)).sum(axis=1).tolist()
        whole = sum(v * v for v in s)
        found = (n * n * q - 2 * n * c + whole for q, c in zip(square, cross))
        return [v if v < 1 << 63 else None for v in found]


def _cross_products(model: Whitener):
    """Sums of whitened values and of their products over a task, at places of a (k + 1) x (k + 1) matrix."""
    def run(batches):
        k = model.axes.shape[1]
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            y = model.project(_unpacked(b.column("x"), model.dims))
            y = np.hstack([y, np.ones((len(y), 1))])
            total += y.T @ y
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)),
                                          pa.array(total.ravel())], ["i", "j", "s"])
    return run


def _whitened(model: Whitener, scale: float, error: float):
    def run(batches):
        k = model.axes.shape[1]
        for b in batches:
            rows, x = integer_vectors(b.column("v"), scale, model.dims)
            if len(rows) == 0 or k == 0:
                continue
            m = len(rows)
            ids = np.repeat(rows, k)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(ids)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, model.n)), pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array(model.project(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(spark: SparkSession, vectors: DataFrame, *, scale: float = SCALE, components: int = COMPONENTS) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding) and component: vec_id, component (from 1), n, deviation,
    whitened, explained, identity_error.

    The model is fitted on each distinct integer vector floor(scale * c) once: n of them.  deviation is the exact
    sum over dimensions of (n * x - S)**2 (NULL where it exceeds a long), whitened the centred vector on the
    component's unit eigenvector over the root of its eigenvalue, explained the component's share of the trace,
    identity_error the largest absolute entry of the whitened fit list's covariance (measured over it) minus the
    identity.

    Rows take no part whose vector is NULL, holds NULL or non-finite entries or integers beyond a long, or has
    another length than most vectors (ties to the longer).  A component needs some variance (``MIN_SHARE``): a
    table of equal vectors, an empty one, and one of empty vectors give no row.  Repeated rows are returned as
    often as they occur, rows without a vec_id too.  Other columns are ignored.
    """
    scratch = C.Scratch(spark, "whitening")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    none = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, "
                                     "explained double, identity_error double")
    common = (rows.where("v is not null").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c"))
              .orderBy(F.desc("c"), F.desc("d")).first())
    dims = common["d"] if common else 0
    if dims == 0:
        return none
    fit = scratch.save(rows.select("v").mapInArrow(_packed(scale, dims), "x binary").distinct(), "fit")
    block = max(64, min(BLOCK_ROWS, BLOCK_ENTRIES // dims // 64 * 64))
    moments = fit.mapInArrow(_moments(dims, block), "i int, j int, " + ", ".join(f"{x} long" for x in _LIMB_NAMES))
    # dims * (dims + 3) / 2 + 1 rows, whatever the input
    found = moments.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in _LIMB_NAMES]).collect()
    value = {(r["i"], r["j"]): sum(r[x] << (LIMB_BITS * k) for k, x in enumerate(_LIMB_NAMES)) for r in found}
    if not value:
        return none
    n, sums = value.pop((-1, -1)), [value.pop((i, -1)) for i in range(dims)]
    model = Whitener(n, sums, value, components)
    k = model.axes.shape[1]
    got = np.zeros((k + 1, k + 1))
    for r in fit.mapInArrow(_cross_products(model), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        got[r["i"], r["j"]] = r["s"]
    mean = got[k, :k] / n
    gap = got[:k, :k] / n - np.outer(mean, mean) - np.eye(k)
    error = float(np.abs(gap).max(initial=0.0))
    scratch.drop(fit)
    return rows.mapInArrow(_whitened(model, scale, error), none.schema)
