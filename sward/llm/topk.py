"""Exact top-k inner-product search: a ball tree per shard, branch and bound.

Candidates are dealt to shards of bounded size by a hash of their id; each shard
becomes one ball tree, stored as one row.  Queries go to every shard in blocks.
Round one descends to the leaf with the best upper bound in each shard, which
gives every query a global k-th score to start from.  Round two searches each
tree best-first with that score shared by all shards: nodes are visited in the
order of the bound  <q, centre> + |q| * radius,  and the search of a tree ends when
the best open bound falls below the k-th score.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sward.llm import common as C

SCALE = 1024
SHARD_ROWS = 8192
BLOCK_QUERIES = 1024
LEAF = 64


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, q): floor(1024 * x) of every component; vectors that are NULL, or hold NULL or a
    non-finite component, are left out."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (vectors.where("embedding is not null and vec_id is not null")
            .select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(ok)
            .select("vec_id", F.transform("x", lambda v: F.floor(v * SCALE)).alias("q")))


def _matrix(rows) -> np.ndarray:
    return np.array([np.asarray(r, dtype=np.int64) for r in rows], dtype=np.int64)


def _safe(points: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Points in a type whose dot products are exact: float64 while sums stay below 2**53, else integers."""
    top = float(np.abs(points).max(initial=0))
    top2 = top if other is None else float(np.abs(other).max(initial=0))
    bound = top * top2 * points.shape[1]
    if bound < 2**53:
        return points.astype(np.float64)
    return points if bound < 2**63 else points.astype(object)


def build_tree(ids: np.ndarray, points: np.ndarray) -> dict:
    """A ball tree: nodes in preorder, points in leaf order."""
    pts = points.astype(np.float64)
    order = np.arange(len(ids))
    centre, radius, low, span, kids = [], [], [], [], []

    def grow(lo: int, hi: int) -> int:
        me = len(centre)
        idx = order[lo:hi]
        p = pts[idx]
        c = p.mean(axis=0)
        gap = np.sqrt(((p - c) ** 2).sum(axis=1))
        centre.append(c)
        radius.append(float(gap.max()) * (1 + 1e-9) + 1e-6)
        low.append(int(ids[idx].min()))
        span.append((lo, hi))
        kids.append((-1, -1))
        if hi - lo > LEAF and gap.max() > 0:
            a = p[gap.argmax()]
            b = p[((p - a) ** 2).sum(axis=1).argmax()]
            order[lo:hi] = idx[np.argsort(p @ (b - a), kind="stable")]
            mid = (lo + hi) // 2
            left = grow(lo, mid)
            kids[me] = (left, grow(mid, hi))
        return me

    grow(0, len(ids))
    return {"ids": ids[order], "points": points[order], "centre": np.array(centre), "radius": np.array(radius),
            "low": np.array(low), "span": np.array(span), "kids": np.array(kids)}


def search(tree: dict, qid: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, first_leaf: bool):
    """(query, vec_id, score) of at most k best per query among scores >= floor."""
    pts = _safe(tree["points"], queries)
    qs = queries.astype(pts.dtype)
    qf = queries.astype(np.float64)
    length = np.sqrt((qf ** 2).sum(axis=1))
    bound = qf @ tree["centre"].T + np.outer(length, tree["radius"])
    bound += np.abs(bound) * 1e-9 + 1e-3
    out = []
    for i in range(len(qid)):
        best: list[tuple] = []  # heap of (score, -vec_id): the root is the k-th result
        ub = bound[i]
        heap = [(-ub[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            kth = (best[0][0], -best[0][1]) if len(best) == k else (floor[i], None)
            if kth[0] is not None and -top < kth[0]:
                break
            left, right = tree["kids"][node]
            if left >= 0:
                heapq.heappush(heap, (-ub[left], int(left)))
                heapq.heappush(heap, (-ub[right], int(right)))
                continue
            lo, hi = tree["span"][node]
            if kth[1] is not None and np.floor(-top) <= kth[0] and tree["low"][node] > kth[1]:
                continue
            ids = tree["ids"][lo:hi]
            score = pts[lo:hi] @ qs[i]
            ok = ids != qid[i]
            if kth[0] is not None:
                ok &= score >= kth[0]
            take = np.flatnonzero(ok)
            if len(take) > k:
                take = take[np.lexsort((ids[take], -score[take].astype(np.float64)))][:k] if pts.dtype != object \
                    else np.array(sorted(take, key=lambda j: (-score[j], ids[j]))[:k])
            for j in take:
                item = (int(score[j]), -int(ids[j]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if first_leaf:
                break
        out += [(int(qid[i]), -v, s) for s, v in best]
    return out


def top_k(spark: SparkSession, vectors: DataFrame, is_query, *, k: int = 10, shard_rows: int = SHARD_ROWS,
          block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest integer inner products per query.

    vectors: (vec_id, embedding); ``is_query`` is a condition on vec_id.  Candidates are
    all vectors but the query's own id; ties go to the smaller vec_id.  All, if there
    are fewer than k.  Vectors that are NULL, of NULL id, or that hold a NULL or
    non-finite component take no part.  A vector is scored against those of its own
    length only, each length in trees of its own (an empty vector scores 0 with empty
    vectors).  Repeated rows count once; a vec_id with several vectors is ranked once
    over the scores of all of them.  A score beyond 64 bits is an error.
    """
    scratch = C.Scratch(spark, "topk")
    pool = scratch.save(quantised(vectors).distinct().withColumn("dims", F.size("q")), "pool")
    n, nq = pool.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-nq // block_queries))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        tree = build_tree(pdf["vec_id"].to_numpy(), _matrix(pdf["q"]))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "dims": [pdf["dims"].iloc[0]], "tree": [pickle.dumps(tree)]})

    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    trees = scratch.save(pool.withColumn("shard", shard).groupBy("shard", "dims").applyInPandas(build, "shard long, dims int, tree binary"), "trees")
    cells = trees.select("shard", "dims", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "tree")
    queries = pool.where(is_query).select("vec_id", "q", "dims", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int").alias("block"))

    def visit(first_leaf: bool):
        def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
            tree = pickle.loads(left["tree"].iloc[0])
            floor = [None if pd.isna(x) else int(x) for x in right["floor"]]
            found = search(tree, right["vec_id"].to_numpy(), _matrix(right["q"]), floor, k, first_leaf)
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])
        return run

    def round_(qs: DataFrame, first_leaf: bool) -> DataFrame:
        sent = qs.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        return (cells.groupBy("shard", "dims", "block").cogroup(sent.groupBy("shard", "dims", "block"))
                .applyInPandas(visit(first_leaf), "query_id long, vec_id long, score long"))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    seen = round_(queries.withColumn("floor", F.lit(None).cast("decimal(19,0)")), True)
    kth = (seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
           .groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor")))
    kth = scratch.save(kth, "kth", 4)
    start = queries.join(kth.select(F.col("query_id").alias("vec_id"), F.col("floor").cast("decimal(19,0)").alias("floor")),
                         "vec_id", "left")
    found = round_(start, False)
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
