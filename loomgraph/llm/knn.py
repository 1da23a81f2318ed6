"""Exact top-k search by inner product with KD-trees per shard.

A shard's tree splits at the median of the widest side of its box; each node
keeps the tight box of its vectors.  The inner product of a query with
anything in a box is at most the sum, over components, of the larger of its
products with the box's two ends.  Nodes are visited in falling order of that
bound; a node whose bound is under the k-th score so far ends the shard, and
the k-th score carries over to the next shard of the block.
"""

from __future__ import annotations

import copy
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import table
from .vectors import Found, best, finite, search

#: Vectors in a leaf and in a shard.
LEAF, SHARD = 128, 4_096
KIND = pa.schema([("query_id", pa.int64()), ("own", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Tree:
    """Nodes in arrays; children of node i are child[i] and child[i] + 1, or it is a leaf with rows first[i]:last[i]."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        self.child, self.first, self.last, low, high = [0], [0], [len(ids)], [None], [None]
        at = 0
        while at < len(self.child):
            a, b = self.first[at], self.last[at]
            own = vectors[order[a:b]]
            low[at], high[at] = own.min(0), own.max(0)
            side = high[at] - low[at]
            if b - a > LEAF and len(side) and side.max() > 0:
                axis, mid = int(side.argmax()), (a + b) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis].astype(np.float64), mid - a)]
                self.child[at] = len(self.child)
                for x, y in ((a, mid), (mid, b)):
                    self.child.append(0)
                    self.first.append(x)
                    self.last.append(y)
                    low.append(None)
                    high.append(None)
            at += 1
        self.low, self.high = np.array(low), np.array(high)
        self._exact: Tree | None = None
        self.ids, self.vectors = ids[order], vectors[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, no less than any inner product in the node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def exact(self) -> Tree:
        """The same tree with integers of any size."""
        if self._exact is None:
            self._exact = copy.copy(self)
            for name in ("low", "high", "vectors"):
                setattr(self._exact, name, whole_numbers(getattr(self, name)))
        return self._exact

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of (ids, scores) and the tree."""
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if len(scores) == k and -b < scores[-1]:
                break
            child = self.child[node]
            if child:
                for c in (child, child + 1):
                    if len(scores) < k or bound[c] >= scores[-1]:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            rows = slice(self.first[node], self.last[node])
            got = self.vectors[rows] @ query
            if got.dtype == object:
                got = np.array([min(max(x, -(2**63)), 2**63 - 1) for x in got.tolist()], object)
            good = self.ids[rows] != own
            if len(scores) == k:
                good &= (got >= scores[-1]).astype(bool)
            if good.any():
                ids, scores = np.concatenate([ids, self.ids[rows][good]]), np.concatenate([scores, got[good]])
                top = best(scores, ids, k) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k])
                ids, scores = ids[top], scores[top]
        return ids, scores


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """Doubles that are integers as integers of any size."""
    out = np.empty(x.shape, object)
    out.flat = [int(c) for c in x.reshape(-1).tolist()]
    return out


def top_k(rows: DataFrame, is_query, k: int, scale: int = 1024) -> DataFrame:
    """Each query's k rows with the largest integer inner product: query_id, rank, vec_id, score.

    rows has vec_id and embedding.  Components become floor(scale * x), x as a
    double; scale is a power of two, so that this is exact.  Vectors that are
    null or hold null or non-finite components, or components too large to be
    scaled, and rows without an id, take no part; empty vectors score 0 with
    each other.  Rows that repeat in full are one row, as query and as
    candidate.  Rows of one id with different vectors are each a query of its
    own (their lists have the same query_id), and never each other's results.
    Inner products that doubles cannot hold are computed with integers of any
    size; scores outside the range of long become its ends.  An empty table
    gives an empty result.
    """
    known = F.col("embedding").cast("array<double>")
    whole = rows.where(finite(F.col("embedding")) & F.forall(known, lambda x: F.abs(x) < F.lit(2.0**1023 / scale))).select(F.col("vec_id").cast("long").alias("vec_id"), known.alias("vec"))

    def prepare(ids: np.ndarray, vectors: np.ndarray):
        vectors = np.floor(vectors * scale)
        trees = [Tree(ids[a : a + SHARD], vectors[a : a + SHARD]) for a in range(0, len(ids), SHARD)]
        most = np.abs(vectors).max(initial=0)

        def ask(query_ids: np.ndarray, queries: np.ndarray) -> Found:
            queries = np.floor(queries * scale)
            small = np.abs(queries).max(axis=1, initial=0) <= 2**53 / max(most * max(queries.shape[1], 1), 1)  # all sums are exact in doubles
            bounds = [t.bounds(queries[small]) for t in trees]
            place = np.cumsum(small) - 1
            for i, query in enumerate(queries):
                found, scores = np.zeros(0, np.int64), np.zeros(0, np.float64 if small[i] else object)
                for j, t in enumerate(trees):
                    if small[i]:
                        found, scores = t.search(query, query_ids[i], bounds[j][place[i]], found, scores, k)
                    else:
                        q, t = whole_numbers(query), t.exact()
                        found, scores = t.search(q, query_ids[i], t.bounds(q[None, :])[0], found, scores, k)
                yield np.full(len(found), i), found, np.array([int(s) for s in scores], np.int64)

        return ask

    return search(whole, is_query, k, prepare, KIND)


def op5_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all embeddings for each whose vec_id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
