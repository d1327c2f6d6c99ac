"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad.  The potentials of a line are
linear in its own features and those of the lines before and after it; a 2 x 2
table couples neighbouring labels.  Training lines take the label of their
document.  A document's quality is the mean of the forward-backward marginals
P(line is good), weighted by the lines' lengths, calibrated by a logistic curve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sward.llm import common as C
from sward.llm.models import SAMPLE_DOCS, apply_logistic, fit_logistic, held_out, labelled_sample

N_FEATURES = 12
EPOCHS, RATE, L2 = 120, 0.1, 1e-3
#: Text handled at once: the arrays over it take some 40 bytes a byte.
SLICE_BYTES = 1 << 20

_CLASS = np.zeros((5, 256), dtype=np.float32)  # upper, digit, stop marks, other symbols, beyond ASCII
for _b in range(256):
    _c = chr(_b)
    if _b >= 128:
        _CLASS[4, _b] = 1
    elif _c.isupper():
        _CLASS[0, _b] = 1
    elif _c.isdigit():
        _CLASS[1, _b] = 1
    elif _c in ".,;:?'\"()-":
        _CLASS[2, _b] = 1
    elif _b > 32 and not _c.isalpha():
        _CLASS[3, _b] = 1


def line_features(column):
    """Features of every non-blank line of a batch of texts.

    Returns (features (lines x N_FEATURES), byte length of each line, line offsets per row).
    """
    data, off = C.string_buffers(column)
    h, row, start, end = C.word_hashes(data, off, lower=False)
    if len(h) == 0:
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0), np.zeros(len(off), np.int64)
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    line = newline[start]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    new = np.flatnonzero(first)
    words = np.diff(np.append(new, len(h))).astype(np.float32)
    lo, hi = start[new], end[np.append(new[1:], len(h)) - 1]
    size = (hi - lo).astype(np.float32)
    at = np.empty(2 * len(lo), dtype=np.int64)
    at[0::2], at[1::2] = lo, hi
    x = np.empty((len(lo), N_FEATURES), dtype=np.float32)
    for c in range(5):
        # bytes between a line's end and the next start are blanks and count as 0
        x[:, c] = np.add.reduceat(_CLASS[c][data], lo) / size
    x[:, 5] = np.log1p(size) / 8
    x[:, 6] = np.minimum(size / words / 10, 3)
    same1 = np.zeros(len(h), dtype=np.float32)
    same1[1:] = (h[1:] == h[:-1]) & ~first[1:]
    x[:, 7] = np.add.reduceat(same1, new) / words
    last = _CLASS[3][data[end - 1]]
    x[:, 8] = np.add.reduceat(last, new) / words  # words that end in a symbol
    key = np.add.reduceat(C.mix64(h), new)  # the line's words, to find repeated lines of one text
    r = row[new]
    order = np.lexsort((key, r))
    again = np.zeros(len(new), dtype=np.float32)
    if len(order) > 1:
        eq = (key[order][1:] == key[order][:-1]) & (r[order][1:] == r[order][:-1])
        again[order[1:][eq]] = 1
        again[order[:-1][eq]] = 1
    x[:, 9] = again
    x[:, 10] = np.log1p(words) / 5
    x[:, 11] = words <= 3
    return x, size, np.searchsorted(r, np.arange(len(off)))


def with_neighbours(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and after (0 outside the text), then 1."""
    n = len(x)
    prev, nxt = np.zeros_like(x), np.zeros_like(x)
    prev[1:], nxt[:-1] = x[:-1], x[1:]
    heads = off[:-1][off[:-1] < off[1:]]
    prev[heads] = 0
    nxt[off[1:][off[:-1] < off[1:]] - 1] = 0
    return np.hstack([x, prev, nxt, np.ones((n, 1), x.dtype)])


def forward_backward(score: np.ndarray, trans: np.ndarray, off: np.ndarray):
    """Marginals of a batch of chains.

    score: log potential of `good` minus `bad` per line; trans: 2 x 2 log table.
    Returns (P(good) per line, pair marginals summed per table cell, log Z per chain).
    All chains advance together; chains are ordered by length so that the active ones are a prefix.
    """
    size = np.diff(off)
    n, chains = len(score), len(size)
    order = np.argsort(-size, kind="stable")
    begin, length = off[:-1][order], size[order]
    emit = np.stack([np.zeros(n), score], axis=1)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    steps = int(length[0]) if chains else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # chains longer than t
    for t in range(steps):
        i = begin[:active[t]] + t
        if t == 0:
            alpha[i] = emit[i]
        else:
            a = alpha[i - 1]
            alpha[i] = emit[i] + np.logaddexp(a[:, :1] + trans[0], a[:, 1:] + trans[1])
    for t in range(steps - 2, -1, -1):
        i = begin[:active[t + 1]] + t
        b = beta[i + 1] + emit[i + 1]
        beta[i] = np.logaddexp(b[:, :1] + trans[:, 0], b[:, 1:] + trans[:, 1])
    log_z = np.full(chains, 0.0)
    some = length > 0
    ends = (begin + length - 1)[some]
    z = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    back = np.zeros(chains)
    back[order[some]] = z
    log_z = back
    per_line = np.repeat(log_z, size)
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - per_line, 0))
    pair = np.zeros((2, 2))
    inner = np.ones(n, dtype=bool)
    inner[off[1:][size > 0] - 1] = False
    i = np.flatnonzero(inner)
    for a in range(2):
        for b in range(2):
            pair[a, b] = np.exp(alpha[i, a] + trans[a, b] + emit[i + 1, b] + beta[i + 1, b] - per_line[i]).sum()
    return good, pair, log_z


def fit(x: np.ndarray, off: np.ndarray, size: np.ndarray, label: np.ndarray) -> dict:
    """CRF weights by Adam on the conditional likelihood, then the calibration curve."""
    z = with_neighbours(x, off).astype(np.float64)
    mean, spread = z.mean(axis=0), z.std(axis=0) + 1e-6
    mean[-1], spread[-1] = 0, 1
    z = (z - mean) / spread
    y = np.repeat(label, np.diff(off)).astype(np.float64)
    w, trans = np.zeros(z.shape[1]), np.zeros((2, 2))
    theta_m, theta_v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    seen = np.zeros((2, 2))  # a training chain has one label throughout
    for lab in (0, 1):
        seen[lab, lab] = np.maximum(np.diff(off)[label == lab] - 1, 0).sum()
    total = len(y)
    for step in range(1, EPOCHS + 1):
        good, pair, _ = forward_backward(z @ w, trans, off)
        grad = np.concatenate([z.T @ (y - good) / total - L2 * w, ((seen - pair) / total - L2 * trans).ravel()])
        theta_m = 0.9 * theta_m + 0.1 * grad
        theta_v = 0.999 * theta_v + 0.001 * grad ** 2
        move = RATE * (theta_m / (1 - 0.9 ** step)) / (np.sqrt(theta_v / (1 - 0.999 ** step)) + 1e-8)
        w, trans = w + move[:-4], trans + move[-4:].reshape(2, 2)
    model = {"w": w, "trans": trans, "mean": mean, "spread": spread}
    model["curve"] = fit_logistic(_document_features(model, x, off, size), label.astype(np.float64), l2=0.1)
    return model


def _document_features(model: dict, x: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length-weighted mean of P(good), as given and as log odds; a text without words counts as bad."""
    z = (with_neighbours(x, off) - model["mean"]) / model["spread"]
    good, _, _ = forward_backward(z @ model["w"], model["trans"], off)
    total = np.concatenate([[0], np.cumsum(size)])
    part = np.concatenate([[0], np.cumsum(size * good)])
    weight = total[off[1:]] - total[off[:-1]]
    q = (part[off[1:]] - part[off[:-1]]) / np.maximum(weight, 1)
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.stack([q, np.log(q / (1 - q)) / 4], axis=1)


def _sample_rows(batches):
    for b in C.slices(batches, data_bytes=SLICE_BYTES):
        x, size, off = line_features(b.column("text"))
        for i, (doc, lab) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist())):
            s = slice(off[i], off[i + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc], pa.int64()), pa.array([lab], pa.int32()), pa.array([x[s].astype("<f4").tobytes()], pa.binary()),
                 pa.array([size[s].astype("<f4").tobytes()], pa.binary())], ["doc_id", "label", "x", "size"])


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> dict:
    """Model from at most ``limit`` labelled documents; {"share": ...} when there is nothing to tell apart."""
    rows = labelled_sample(docs, labels, "quality", limit).mapInArrow(
        C.releasing(_sample_rows, first=True), "doc_id long, label int, x binary, size binary").collect()  # the lines of at most limit documents
    rows.sort(key=lambda r: r["doc_id"])
    label = np.array([r["label"] for r in rows], dtype=np.int64)
    if len(label) == 0 or label.min() == label.max():
        return {"share": float(label.mean()) if len(label) else 0.5}
    x = np.concatenate([np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES) for r in rows])
    size = np.concatenate([np.frombuffer(r["size"], "<f4") for r in rows]).astype(np.float64)
    off = np.concatenate([[0], np.cumsum([len(r["size"]) // 4 for r in rows])])
    if len(x) == 0:
        return {"share": float(label.mean())}
    return fit(x, off, size, label)


def _scorer(model: dict):
    def run(batches):
        for b in C.slices(batches, data_bytes=SLICE_BYTES):
            if "share" in model:
                p = np.full(b.num_rows, model["share"])
            else:
                x, size, off = line_features(b.column("text"))
                p = apply_logistic(model["curve"], _document_features(model, x, off, size.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(p, pa.float64())],
                                             ["doc_id", "score"])
    return run


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, limit: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    labels: (doc_id, quality); rows whose crc32(doc_id) modulo 3 is 1 are never
    learned from.  NULL, empty and blank texts have no lines and score as if all
    were bad.  Without labels of both kinds every text scores the share of good
    ones (0.5 without any).  Repeated rows score alike; a NULL doc_id counts as not
    held out.  Other columns are ignored.
    """
    model = train(docs, labels, limit)
    scored = docs.select("doc_id", "text").mapInArrow(C.releasing(_scorer(model)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, limit: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` without the rows whose text the classifier rejects (score below 0.5)."""
    model = train(docs, labels, limit)
    scorer = _scorer(model)

    def run(batches):
        for b in C.slices(batches, data_bytes=SLICE_BYTES):
            score = next(scorer(iter([b.select(["doc_id", "text"])]))).column("score").to_numpy()
            yield b.filter(pa.array(score >= 0.5))
    return docs.mapInArrow(C.releasing(run, first=True), docs.schema)
