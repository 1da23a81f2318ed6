"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are integers up to the capacity, so the instance is a histogram of at
most that many numbers, whatever the corpus.  The driver gets the histogram
only, reduces it by dominance, packs the rest best-fit in order of falling
length, and returns a plan of intervals: the pieces of length s ranked a to b
go to the sequences from x on, q to each, from place o on.  Sequences with
equal contents so far stay one interval, so the plan has as many rows as there
are changes, not pieces.  Workers then find the place of each piece from its
length and its rank among the pieces of that length.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import checkpointed, partitions, table, typed

#: Chunks between white space that a worker keeps encoded, and their bytes; beyond either, the cache starts anew.
CACHE_CHUNKS, CACHE_BYTES = 1_500_000, 32 << 20
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Chunks:
    """Encodes texts by a public tokenizer that drops white space: each distinct chunk between white space once.

    Chunks are found by a hash, and their bytes compared; a batch in which two
    chunks share a hash is encoded chunk by chunk.  The strings of the
    tokenizer's special tokens are read as the library reads them: as those.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.text, self.from_, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)  # each chunk's bytes

    def _made(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks laid end to end, and how many each has."""
        raw = data.tobytes()
        made = [x.ids for x in self.t.encode_batch_fast([raw[i:j].decode() for i, j in zip(starts.tolist(), ends.tolist())], add_special_tokens=False)]
        counts = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter((i for ids in made for i in ids), np.int32, int(counts.sum())), counts

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and where each text's begin (len + 1)."""
        starts, ends, doc = tv.words(data, offsets)
        keys = tv.spans_hash(data, starts, ends)
        unique, sample, inverse = np.unique(keys, return_index=True, return_inverse=True)
        place = self._known(unique)
        new = np.flatnonzero(place < 0)
        if len(new):
            a, b = starts[sample[new]], ends[sample[new]]
            if len(self.keys) + len(new) > CACHE_CHUNKS or len(self.text) + int((b - a).sum()) > CACHE_BYTES:
                self._forget()
                new = np.arange(len(unique))
                a, b = starts[sample], ends[sample]
            ids, counts = self._made(data, a, b)
            first, from_ = np.cumsum(counts) - counts + len(self.ids), np.cumsum(b - a) - (b - a) + len(self.text)
            self.ids, self.text = np.concatenate([self.ids, ids]), np.concatenate([self.text, tv.gather(data, a, b - a)])
            known = np.concatenate([self.keys, unique[new]])
            order = np.argsort(known, kind="stable")
            self.keys, self.first, self.count = known[order], np.concatenate([self.first, first])[order], np.concatenate([self.count, counts])[order]
            self.from_, self.size = np.concatenate([self.from_, from_])[order], np.concatenate([self.size, b - a])[order]
            place = self._known(unique)
        where = place[inverse]
        n = self.count[where]
        ids = tv.gather(self.ids, self.first[where], n)
        if not np.array_equal(self.size[where], ends - starts) or not np.array_equal(tv.gather(self.text, self.from_[where], ends - starts), data[~tv.SPACE[data]]):
            ids, n = self._made(data, starts, ends)
        return ids, np.concatenate(([0], np.cumsum(n)))[doc]


_CHUNKS: dict[str, Chunks] = {}


def chunks(path: str) -> Chunks:
    if path not in _CHUNKS:
        _CHUNKS[path] = Chunks(path)
    return _CHUNKS[path]


def pieces(docs: DataFrame, path: str, capacity: int, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's ids and then end, cut after every capacity ids: doc_id, piece, start, length, ids_crc32.

    A null or empty text is the end id alone.  Repeated rows and null keys are
    kept as they are; other columns are left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = chunks(path)
        for b, data, offsets in tv.pieces(batches, "text"):
            ids, at = c.batch(data, offsets)
            n = np.diff(at) + 1
            cuts = -(-n // capacity)
            doc, piece = tv.joined(cuts)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            raw, tail = memoryview(ids.astype("<u4").tobytes()), np.array([end], "<u4").tobytes()
            first = at[:-1][doc] + start
            last = start + length == n[doc]
            crc = [zlib.crc32(tail, zlib.crc32(raw[4 * i : 4 * (i + m - 1)])) if z else zlib.crc32(raw[4 * i : 4 * (i + m)]) for i, m, z in zip(first.tolist(), length.tolist(), last.tolist())]
            yield from typed([{"doc_id": b.column(0).take(pa.array(doc)), "piece": piece, "start": start, "length": length, "ids_crc32": crc}], schema)

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, PIECE)


class Plan:
    """Where the pieces of each length go. counts[s]: how many pieces have length s."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.left = capacity, [int(c) for c in counts]
        self.used = [0] * (capacity + 1)  # ranks given out, by length
        self.bins = 0
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # length, rank from, rank to, sequence, pieces to each, offset
        self.fixed = 0
        self.open: dict[int, list[tuple[int, int]]] = {}  # by room left: intervals of sequences
        self.rooms: list[int] = []
        self.reduce()
        self.fixed = self.bins
        self.best_fit()

    def put(self, s: int, n: int, first: int, each: int, offset: int) -> None:
        """n more pieces of length s go to the sequences from first on."""
        self.rows.append((s, self.used[s], self.used[s] + n, first, each, offset))
        self.used[s] += n
        self.left[s] -= n

    def fix(self, n: int, *lengths: int) -> None:
        """n sequences get one piece of each of these lengths and are closed."""
        offset = 0
        for s in lengths:
            self.put(s, n, self.bins, 1, offset)
            offset += s
        self.bins += n

    def reduce(self) -> None:
        """Fixes sets that dominate every other feasible set with the same longest piece, until none is left."""
        changed = True
        while changed:
            changed = False
            sizes = [s for s in range(1, self.capacity + 1) if self.left[s]]
            for j in reversed(sizes):
                while self.left[j]:
                    room = self.capacity - j
                    low = self._smallest(3, j)
                    if not low or low[0] > room:
                        self.fix(self.left[j] if 2 * j > self.capacity else 1, j)
                        changed = True
                        continue
                    best = self._largest(room, j)
                    single = len(low) < 2 or low[0] + low[1] > room
                    pair = len(low) < 3 or sum(low) > room
                    if best == room or single or pair and best >= self._best_pair(room, j):
                        n = self.left[j] // 2 if best == j else min(self.left[j], self.left[best])
                        if best != room and not single:
                            n = 1  # what the rule looked at changes with every piece
                        elif best != room:
                            n = max(1, n - 1) if best != j else 1
                        self.fix(n, j, best)
                        changed = True
                        continue
                    break

    def _smallest(self, k: int, without: int) -> list[int]:
        """Lengths of the k shortest pieces but one of length without."""
        out: list[int] = []
        for s in range(1, self.capacity + 1):
            n = self.left[s] - (s == without)
            if n > 0:
                out += [s] * min(n, k - len(out))
                if len(out) == k:
                    break
        return out

    def _largest(self, room: int, without: int) -> int:
        for s in range(room, 0, -1):
            if self.left[s] - (s == without) > 0:
                return s
        return 0

    def _best_pair(self, room: int, without: int) -> int:
        """The largest sum of two pieces' lengths that fits, or 0."""
        have = [s for s in range(1, room + 1) if self.left[s] - (s == without) > 0]
        most, i, k = 0, 0, len(have) - 1
        while i <= k:
            total = have[i] + have[k]
            twice = i < k or self.left[have[i]] - (have[i] == without) > 1
            if total <= room:
                if twice:
                    most = max(most, total)
                i += 1
            else:
                k -= 1
        return most

    def best_fit(self) -> None:
        """The rest, longest first, each to the sequence with the least room that holds it."""
        for s in range(self.capacity, 0, -1):
            while self.left[s]:
                at = bisect_left(self.rooms, s)
                if at == len(self.rooms):
                    each = self.capacity // s
                    bins = -(-self.left[s] // each)
                    first, room = self.bins, self.capacity
                    self.bins += bins
                else:
                    room = self.rooms[at]
                    first, bins = self.open[room].pop()
                    if not self.open[room]:
                        del self.open[room]
                        self.rooms.pop(at)
                self._fill(s, first, bins, room)

    def _fill(self, s: int, first: int, bins: int, room: int) -> None:
        each, n = room // s, self.left[s]
        full = min(bins, n // each)
        if full:
            self.put(s, full * each, first, each, self.capacity - room)
            self._give(room - each * s, first, full)
        some = self.left[s] if full < bins else 0
        if some and some < each:
            self.put(s, some, first + full, some, self.capacity - room)
            self._give(room - some * s, first + full, 1)
            full += 1
        if full < bins:
            self._give(room, first + full, bins - full)

    def _give(self, room: int, first: int, bins: int) -> None:
        if room not in self.open:
            insort(self.rooms, room)
            self.open[room] = []
        self.open[room].append((first, bins))

    def table(self) -> np.ndarray:
        """The plan's rows in order of length and rank."""
        rows = np.array(self.rows, np.int64).reshape(-1, 6)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def ranked(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """df with rank: 0, 1, 2, ... among the rows with the same value of by, without bringing such rows together.

    Rows are dealt to as many blocks as the cluster has shuffle partitions by a
    hash of their contents, ranked in each block, and moved up by the counts of
    the blocks before.  A value that a third of all rows has is thus spread over
    all blocks.
    """
    blocks = partitions(df.sparkSession)
    dealt = df.withColumn("block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    own = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("block", by).orderBy(*order)).cast("long") - 1)
    n = own.groupBy("block", by).count()
    before = n.withColumn("before", F.sum("count").over(Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("block").alias("b_"), F.col(by).alias("v_"), F.coalesce("before", F.lit(0)).alias("before"))
    joined = own.join(before, (own["block"] == before["b_"]) & own[by].eqNullSafe(before["v_"]))
    return joined.withColumn("rank", F.col("rank") + F.col("before")).drop("before", "b_", "v_", "block")


def pack(made: DataFrame, capacity: int) -> DataFrame:
    """made (doc_id, piece, start, length, ids_crc32) with sequence_id and offset: as few sequences of at most capacity as can be found.

    Lengths must be from 1 to capacity.  Nothing is dropped; an empty table
    gives an empty result.  The broadcast plan has at most a row for each
    length and interval of alike sequences, which the capacity bounds.
    """
    spark = made.sparkSession
    made = checkpointed(made)
    counts = np.zeros(capacity + 1, np.int64)
    for row in made.groupBy("length").count().collect():  # at most capacity rows
        counts[row[0]] = row[1]
    plan = Plan(counts, capacity).table()
    shared = spark.sparkContext.broadcast(plan)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            _, low, _, first, each, offset = rows[np.searchsorted(keys, (length << 44) + rank, "right") - 1].T
            place = rank - low
            columns = {n: b.column(n) for n in schema.names[:5]} | {"sequence_id": first + place // each, "offset": offset + place % each * length}
            yield from typed([columns], schema)

    return ranked(made, "length", ["doc_id", "piece", "start", "ids_crc32", "length"]).select(*schema.names[:5], "rank").mapInArrow(run, f"{PIECE}, sequence_id long, offset long")


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1), 4096)
