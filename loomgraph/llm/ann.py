"""Approximate nearest neighbours by inner product with multiprobe p-stable hashing.

Largest inner product becomes smallest distance by one more component: vectors
of about the same norm (within an octave) get what brings them to the largest
norm among them, queries get 0.  Each table hashes with M projections,
floor((a.x + b) / w), a drawn from the normal distribution, which is 2-stable:
the difference of two projections is normal with their distance as deviation.

A query visits the buckets of a table in order of estimated success: a bucket
that is off in some projections costs the sum of the squared distances from
the query's projection to the bucket's interval there, and the smaller the
cost, the likelier a near vector is inside.  It goes on until it has seen the
given share of the vectors.  (Embeddings without much structure need a large
share: among them the twentieth neighbour is hardly nearer than most.)  Candidates of all tables are merged and ranked by
exact inner products.  A bucket is visited whole, however many vectors share
it; blocks of rows are dealt by a hash, so that a hot bucket is spread over
all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import table
from .vectors import Found, best, finite, search

#: Tables, projections of each, width of an interval in units of the largest norm, and share of the vectors that a query sees in each table.
TABLES, PROJECTIONS, WIDTH, SHARE = 3, 8, 1.5, 0.32
#: Queries whose products with a block are computed at once.
AT_ONCE = 64


class Index:
    """Hash tables over vectors of about one norm."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, tables: int, projections: int, width: float, seed: int = 7):
        self.ids, self.vectors = ids, vectors
        norm2 = (vectors**2).sum(1)
        top = norm2.max()
        lifted = np.concatenate([vectors, np.sqrt(np.maximum(top - norm2, 0))[:, None]], 1)
        rng = np.random.default_rng(seed)
        self.scale = np.sqrt(top)
        self.width = width * self.scale
        self.tables = []
        for _ in range(tables):
            a, b = rng.standard_normal((lifted.shape[1], projections)), rng.random(projections) * self.width
            keys = np.floor((lifted @ a + b) / self.width).astype(np.int64)
            buckets, inverse, counts = np.unique(keys, axis=0, return_inverse=True, return_counts=True)
            rows = np.argsort(inverse.reshape(-1), kind="stable")
            self.tables.append((a[:-1], b, buckets, np.cumsum(counts) - counts, counts, rows))

    def search(self, queries: np.ndarray, share: float) -> Iterator[np.ndarray]:
        """For each query, the places of its candidates."""
        length = np.sqrt((queries**2).sum(1))
        # Any positive multiple of a query has the same nearest vectors: use the one of the vectors' norm.
        queries = queries * (self.scale / np.where(length > 0, length, 1))[:, None]
        places = [queries @ a + b for a, b, *_ in self.tables]
        for i in range(len(queries)):
            hit = np.zeros(len(self.ids), bool)
            for (_, _, buckets, first, counts, rows), place in zip(self.tables, places):
                under = buckets * self.width - place[i]
                off = np.maximum(np.maximum(under, -under - self.width), 0)
                order = np.argsort(np.einsum("ij,ij->i", off, off), kind="stable")
                seen = np.cumsum(counts[order])
                own = order[: int(np.searchsorted(seen, share * len(self.ids))) + 1]
                hit[tv.gather(rows, first[own], counts[own])] = True
            yield np.flatnonzero(hit)


def nearest(rows: DataFrame, is_query, k: int, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, share: float = SHARE) -> DataFrame:
    """Each query's k rows of largest inner product among its candidates: query_id, rank, vec_id, score (double, on the vectors as they are).

    rows has vec_id and embedding.  Vectors that are null, zero or empty, or
    hold null or non-finite components, and rows without an id, take no part.
    Rows that repeat in full are one row, as query and as candidate.  Rows of
    one id with different vectors are each a query of its own (their lists have
    the same query_id), and never each other's results.  Scores add the
    products up in one order for every row, so equal vectors have equal scores;
    ties go to the smaller id.  If a block has fewer candidates than k, all its
    rows are looked at.  An empty table gives an empty result.
    """
    whole = rows.where(finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))

    def prepare(ids: np.ndarray, vectors: np.ndarray):
        octave = np.floor(0.5 * np.log2((vectors**2).sum(1)) + 0.5)
        parts = [np.flatnonzero(octave == o) for o in np.unique(octave)]
        indexes = [Index(ids[p], vectors[p], tables, projections, width) for p in parts]

        def ask(query_ids: np.ndarray, queries: np.ndarray) -> Found:
            chosen = [x.search(queries, share) for x in indexes]
            for start in range(0, len(queries), AT_ONCE):
                some = queries[start : start + AT_ONCE]
                rough = [some @ x.vectors.T for x in indexes]
                for i, q in enumerate(some, start):
                    found, scores = [], []
                    for x, own, products in zip(indexes, chosen, rough):
                        at = next(own)
                        at = at[x.ids[at] != query_ids[i]]
                        if len(at) < k:
                            at = np.flatnonzero(x.ids != query_ids[i])
                        got = products[i - start][at]
                        if len(got) > k:  # with room for rounding; what is left is summed in one order
                            edge = np.partition(got, len(got) - k)[len(got) - k]
                            at = at[got >= edge - 1e-9 * max(abs(edge), x.scale * math.sqrt(float(q @ q)))]
                        got = (x.vectors[at] * q).sum(1)
                        top = best(got, x.ids[at], k)
                        found.append(x.ids[at][top])
                        scores.append(got[top])
                    found, scores = np.concatenate(found), np.concatenate(scores)
                    top = best(scores, found, k)
                    yield np.full(len(top), i), found[top], scores[top]

        return ask

    return search(whole, is_query, k, prepare)


def op3_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings for each whose vec_id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
