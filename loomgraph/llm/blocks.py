"""Exchange of packed keys between blocks of documents and slices of the key space.

Some operators must know of each of the corpus's many keys (n-grams) how often
it occurs anywhere.  A row for each would be dear, so documents are dealt to
blocks and keys to slices, and what a block has to tell a slice travels as one
row with packed arrays; the slice answers with an array in the same order.
A block or slice has a bounded number of bytes of text, whatever the corpus;
small corpora get as many as fill the cluster's shuffle width.  A key that is
in a third of all documents comes once from each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import checkpointed, partitions


#: Labels up to which blocks and slices spread evenly over the shuffle's partitions; among more of them chance does as well.
EVEN = 16_384
#: Bytes of text of a block of documents, and those whose keys fall into one slice, on average.
BLOCK, SLICE = 8 << 20, 12 << 20
#: Bytes of rows with one id and text (and ROW more a row) from which on they are spread over all blocks.
REPEATS, ROW = 4 << 20, 64
#: Ids of such rows that are broadcast, 8 bytes each; more of them are joined by a shuffle.
SENT = 1_000_000


def size_of(docs: DataFrame, text: str) -> int:
    """Bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length(docs[text]))).first()[0] or 0)


def labels(df: DataFrame, n: int) -> np.ndarray:
    """n labels of blocks or slices such that about as many fall into every partition of a shuffle."""
    width = partitions(df.sparkSession)
    if n > EVEN:
        return np.arange(n, dtype=np.int32)
    each = -(-n // width)
    some = df.sparkSession.range(24 * each * width).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.hash("k"), F.lit(width)).alias("p"))
    lanes: dict[int, list[int]] = {}
    for k, p in some.collect():  # a few times n rows
        lanes.setdefault(p, []).append(k)
    if any(len(lanes.get(p, ())) < each for p in range(width)):
        return np.arange(n, dtype=np.int32)
    return np.array([lanes[i % width][i // width] for i in range(n)], np.int32)


def blocks(df: DataFrame, size: int) -> np.ndarray:
    return labels(df, max(4 * partitions(df.sparkSession), -(-size // BLOCK)))


def slices(df: DataFrame, size: int) -> np.ndarray:
    return labels(df, max(partitions(df.sparkSession), -(-size // SLICE)))


def places(names: np.ndarray, column: pa.ChunkedArray) -> np.ndarray:
    """The number of each label in a column; -1 for a value that is none."""
    order = np.argsort(names)
    values = column.to_numpy()
    at = np.minimum(np.searchsorted(names[order], values), len(names) - 1)
    return np.where(names[order][at] == values, order[at], -1)


def dealt(docs: DataFrame, key: str, text: str, size: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """block, doc_id, text and the columns keep; rows are dealt by a hash of id and text.

    Rows that repeat in full meet in one block, unless they are too many for
    one: then each goes its own way.  Where to is written to the checkpoint
    folder, so that every pass, and one repeated after a loss, sees the same.
    """
    names = blocks(docs, size)
    others = [docs[c].alias(f"keep_{c}") for c in keep]
    rows = docs.select(F.xxhash64(docs[key], docs[text]).alias("row"), docs[key].cast("long").alias("doc_id"), docs[text].alias("text"), *others)
    hot = checkpointed(rows.groupBy("row").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW).alias("bytes")).where(F.col("bytes") > REPEATS).select("row"))
    n = hot.count()
    if n:
        hot = F.broadcast(hot) if n <= SENT else hot
        apart = F.xxhash64("row", F.monotonically_increasing_id())
        rows = rows.join(hot, "row", "left_anti").unionByName(checkpointed(rows.join(hot, "row", "left_semi").withColumn("row", apart)))
    number = F.pmod(F.col("row"), F.lit(len(names))).cast("int")
    block = F.element_at(F.array(*[F.lit(int(x)) for x in names]), number + 1) if len(names) <= EVEN else number
    return rows.withColumn("row", block).withColumnRenamed("row", "block")


def hashed(t: pa.Table, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a block, and the index of each text's first word (len + 1)."""
    parts, first = [], [np.zeros(1, np.int64)]
    for _, data, offsets in tv.pieces(t.select(["text"]).to_batches()):
        h, f = tv.word_hashes(data, offsets, lower)
        parts.append(h)
        first.append(f[1:] + first[-1][-1])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate(first)


def slice_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The slice of each key; rises with the key."""
    return ((keys >> tv.U(32)) * tv.U(n) >> tv.U(32)).astype(np.int64)


def cuts(keys: np.ndarray, names: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(label, from, to) of sorted keys for each slice that has any."""
    which = slice_of(keys, len(names))
    first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1]))) if len(which) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(which))
    return zip(names[which[first]].tolist(), first.tolist(), last.tolist())


def laid(column: pa.ChunkedArray, dtype: str, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Packed arrays of a column end to end, and the length of each."""
    rows = column.to_pylist()
    if order is not None:
        rows = [rows[i] for i in order]
    n = np.fromiter((len(r) for r in rows), np.int64, len(rows)) // np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(rows), dtype), n
