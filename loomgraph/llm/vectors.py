"""What the two vector searches share: which rows take part, and queries against all rows in blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries that one task holds at most, in expectation.
ROWS, QUERIES = 32_768, 8_192

RESULT = pa.schema([("query_id", pa.int64()), ("own", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of lists of dim doubles as a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(rows: DataFrame, is_query: Column, k: int, prepare: Callable[[np.ndarray, np.ndarray], Callable], kind: pa.Schema = RESULT) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows but its own id, ties to the smaller vec_id.

    rows has vec_id and vec (array of double); vectors of one length are
    compared with each other.  Rows that repeat in full are one row.  Rows of
    one id with different vectors are each a query, with a list of its own, and
    are never each other's results.  Blocks of rows, dealt by a hash of id and
    vector, meet blocks of queries; prepare(ids, vectors) indexes a block of
    rows and returns a function from (query ids, query vectors) to (query
    numbers, ids, scores) that gives each query's k best of the block.
    """
    once = rows.where(F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "vec"]).withColumn("dim", F.size("vec"))
    total, asked = once.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    parts, asks = max(1, math.ceil(total / ROWS)), max(1, math.ceil(asked / QUERIES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hashed = F.xxhash64("vec_id", "vec")
    block = once.withColumn("part", F.pmod(hashed, F.lit(parts)).cast("int")).withColumn("ask", spread(asks))
    query = once.where(is_query).withColumn("own", hashed).withColumn("ask", F.pmod(hashed, F.lit(asks)).cast("int")).withColumn("part", spread(parts))
    keys = ["dim", "part", "ask"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        dim = key[0].as_py()
        order = np.argsort(left.column("vec_id").to_numpy(), kind="stable")
        ask = prepare(left.column("vec_id").to_numpy()[order], matrix(left.column("vec"), dim)[order])
        ids = right.column("vec_id").to_numpy()
        out = list(ask(ids, matrix(right.column("vec"), dim)))
        if not out:
            return kind.empty_table()
        who, found, scores = (np.concatenate(x) for x in zip(*out))
        own = right.column("own").to_numpy()
        return pa.Table.from_arrays([pa.array(ids[who]), pa.array(own[who]), pa.array(found), pa.array(scores, kind.field("score").type)], schema=kind)

    score = "long" if pa.types.is_integer(kind.field("score").type) else "double"
    found = block.groupBy(*keys).cogroup(query.groupBy(*keys)).applyInArrow(run, f"query_id long, own long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, best first."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        place = np.flatnonzero(scores >= edge)
        return place[np.lexsort((ids[place], -scores[place]))[:k]]
    return np.lexsort((ids, -scores))[:k]


Found = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]
