"""Small numpy models fitted on bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sward.llm.common import crc_bucket

#: Classifiers learn from at most this many labelled documents (those with the smallest id hash).
SAMPLE_DOCS = 6000
#: Documents whose crc32 modulo SPLIT is HELD_OUT are never learned from.
SPLIT, HELD_OUT = 3, 1


def held_out(doc_id):
    return F.coalesce(crc_bucket(doc_id, SPLIT) == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, label, text) of at most ``limit`` labelled training documents.

    A document labelled more than once counts once, with the smallest label.  Rows
    without id, label or text are left out.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()
                          & (crc_bucket(F.col("doc_id"), SPLIT) != HELD_OUT))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label")))
    # twice as many ids as wanted, as some may have no document; bounded by the parameter
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * limit)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    found = text.join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights (bias last, not penalised) of an L2 logistic regression, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(a.shape[1], l2)
    penalty[-1] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = sigmoid(a @ w)
        grad = a.T @ (p - y) + penalty * w
        hess = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def apply_logistic(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])
