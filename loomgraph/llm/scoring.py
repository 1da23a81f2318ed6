"""Language-model scores from a log-frequency Bloom filter.

The filter holds, for each word, pair and triple of the training texts, its
count on a logarithmic scale: an n-gram of level L is entered L times, as
(n-gram, 1) to (n-gram, L).  Reading it asks for level 1, 2, ... until the
answer is no, so an error can only overstate, and each further level of it is
as unlikely again.  All counts of the model are read that way.  A word's
probability after its two predecessors is the triple's count, smoothed by a
prior of MASS occurrences spread as the pair's probability says, which is
smoothed by the word's alone in the same way.

The filter is built in slices of the key space, as many as the bytes of text
require, so a slice holds a bounded number of n-grams and scores depend on the
tables only.  A slice tells n-grams apart by 32 bits of their hash (on top of
those that choose the slice; words by 64): a wrong match has a probability of
about 5e-4 a reading, at any size of the corpus, against 1.4e-3 of the filter
itself.  The
filter of a small corpus is broadcast, and blocks of documents probe it on the
spot.  That of a larger one stays in slices: a block sends its distinct n-grams
with their counts once, the slice builds its part of the filter from what all
blocks sent, probes it, and sends the levels back.  Both read the same bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .blocks import cuts, dealt, hashed, labels, places, slice_of
from .runtime import checkpointed, partitions, table

#: Ratio of neighbouring levels, hash functions, and bits for each entry (a false answer in about 1 of 700).
RATIO, PROBES, BITS = 1.5, 7, 14
#: Occurrences that the lower order's probability counts for.
MASS = 4.0
#: Bytes of text up to which the filter is broadcast. Each byte gives at most 1.5 entries of BITS bits: at most 126 MB.
BROADCAST = 48 << 20
END, START = tv.U(0x9D5C1B7E3A4F6081), tv.U(0x1F83D9ABFB41BD6B)
#: Bytes of an n-gram's key inside its slice, and of text whose n-grams fall into one slice, on average.
WIDTH, SLICE = 4, 6 << 20
#: Tokens that a task counts before it passes the words on.
TOKENS = 2_000_000
KEY = tv.U((1 << 8 * WIDTH) - 1)
GRAM = tv.U(1 << 8 * WIDTH)  # sets keys of pairs and triples apart from words in the filter

LEVELS = np.array([0.0, *(0.5 * (math.ceil(RATIO ** (i - 1)) + max(math.ceil(RATIO ** (i - 1)), math.ceil(RATIO**i) - 1)) for i in range(1, 110))])


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(RATIO) + 1e-9).astype(np.int64)


def _hashes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and stride (odd) of the probes for (key, level)."""
    x = tv.mix(keys * tv.U(0x9E3779B97F4A7C15) + tv.U(level))
    return x >> tv.U(32), (x & tv.U(0xFFFFFFFF)) | tv.U(1)


def _place(a: np.ndarray, b: np.ndarray, probe: int, size: np.ndarray) -> np.ndarray:
    """The bit that a probe looks at, in filters of so many bits (under 2**32)."""
    return (((a + tv.U(probe) * b) & tv.U(0xFFFFFFFF)) * size >> tv.U(32)).astype(np.int64)


def built(keys: np.ndarray, counts: np.ndarray, each: int = BITS) -> bytes:
    """A filter of these distinct keys; counts are 1 or more."""
    level = levels_of(counts)
    size = max(64, -(-int(level.sum()) * each // 8) * 8)
    bits = np.zeros(size, np.uint8)
    for j in range(1, int(level.max(initial=0)) + 1):
        a, b = _hashes(keys[level >= j], j)
        for i in range(PROBES):
            bits[_place(a, b, i, tv.U(size))] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def joined(parts: dict[int, bytes], n: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Filters of slices end to end: bits and first bit of each of n slices, and all bytes. A slice without one has an empty one."""
    size, base = np.full(n, 64, np.uint64), np.zeros(n, np.int64)
    at, raw = 8, [b"\0" * 8]
    for s, part in sorted(parts.items()):
        size[s], base[s] = 8 * len(part), 8 * at
        raw.append(part)
        at += len(part)
    return size, base, b"".join(raw)


class Filter:
    """Joined slices, or one, ready for probes; holds no copy of the bytes."""

    def __init__(self, size: np.ndarray, base: np.ndarray, raw: bytes):
        self.size, self.base, self.bytes = size, base, np.frombuffer(raw, np.uint8)

    def levels(self, keys: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
        """The level that each key has in the slice where (the first one, if not given), 0 if it isn't there."""
        out = np.zeros(len(keys), np.uint8)
        where = np.zeros(len(keys), np.int64) if where is None else where
        left, level = np.arange(len(keys)), 1
        while len(left) and level < len(LEVELS):
            size, base = self.size[where[left]], self.base[where[left]]
            a, b = _hashes(keys[left], level)
            for i in range(PROBES):  # a key that is absent is so mostly by the first or second bit
                bit = base + _place(a, b, i, size)
                yes = (self.bytes[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                if not yes.all():
                    left, size, base, a, b = left[yes], size[yes], base[yes], a[yes], b[yes]
            out[left] = level
            level += 1
        return out


def trained(key: Column) -> Column:
    """Whether a document teaches: crc32 of its id as text, modulo 7, is not 2. A null id counts as the empty text (it does)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2


def distinct(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct keys in order, the place of each key there, and the sums of the weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), None if weight is None else weight.astype(np.int64)
    order = np.argsort(keys)
    own = keys[order]
    new = np.concatenate(([True], own[1:] != own[:-1]))
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return own[first], place, None if weight is None else np.add.reduceat(weight[order].astype(np.int64), first)


def pair(a: np.ndarray, b: np.ndarray, order: int) -> np.ndarray:
    return tv.mix(a * tv.U(0xC2B2AE3D27D4EB4F) + b + tv.U(order))


class Tokens:
    """Words and ends of a block's texts, and their pairs and triples. teaches: of each text, whether its counts count."""

    def __init__(self, h: np.ndarray, first: np.ndarray, n: int):
        self.word = np.insert(h, first[1:], END)
        self.at = first + np.arange(len(first))  # where each text's begin (len + 1)
        self.head = self.at[:-1]
        before = np.empty(len(self.word), np.uint64)
        before[1:] = self.word[:-1]
        before[self.head] = START
        pairs = pair(before, self.word, 2)
        triples = np.empty(len(self.word), np.uint64)
        triples[1:] = pair(pairs[:-1], self.word[1:], 3)
        triples[self.head] = START  # a text's first token has none; this stands for the start itself
        self.grams = np.concatenate([pairs, triples])
        self.grams = (slice_of(self.grams, n).astype(np.uint64) << tv.U(8 * WIDTH)) | (self.grams & KEY)

    def weights(self, teaches: np.ndarray) -> np.ndarray:
        return np.repeat(teaches.astype(np.int64), np.diff(self.at))


def planes(values: np.ndarray, width: int) -> bytes:
    """The lowest bytes of all values, then the next ones: sorted or small values give long runs, which Spark's compression takes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplaned(raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of several planes() end to end, and the number of each."""
    n = np.array([len(r) // width for r in raw], np.int64)
    out = np.zeros((int(n.sum()), 8), np.uint8)
    at = 0
    for r, m in zip(raw, n.tolist()):
        out[at : at + m, :width] = np.frombuffer(r, np.uint8).reshape(width, m).T
        at += m
    return out.reshape(-1).view("<u8"), n


def totals(docs: DataFrame, key: str, text: str) -> tuple[int, int, int]:
    """Training tokens, distinct ones among them, and bytes of all texts."""
    n = labels(docs, partitions(docs.sparkSession))
    told = pa.schema([("slice", pa.int32()), ("words", pa.binary()), ("n", pa.int64()), ("size", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, tokens, size = [], 0, 0, 0

        def out() -> pa.RecordBatch:
            keys = np.unique(np.concatenate(words))
            rows = [(s, planes(keys[a:b], 8), 0, 0) for s, a, b in cuts(keys, n)] + [(int(n[0]), b"", tokens, size)]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), told)], schema=told)

        for b, data, offsets in tv.pieces(batches, "text"):
            h, first = tv.word_hashes(data, offsets, lower=True)
            teaches = b.column(1).to_numpy(zero_copy_only=False)
            own = h[np.repeat(teaches, np.diff(first))]
            words.append(np.unique(own))
            if teaches.any():
                words.append(np.array([END]))
            tokens, size, held = tokens + len(own) + int(teaches.sum()), size + len(data), held + len(h)
            if held > TOKENS:
                yield out()
                words, held, tokens, size = [], 0, 0, 0
        if words:
            yield out()

    def merged(k: tuple, t: pa.Table) -> pa.Table:
        v = len(np.unique(unplaned(t.column("words").to_pylist(), 8)[0]))
        return pa.table({"v": [v], "n": [sum(t.column("n").to_pylist())], "size": [sum(t.column("size").to_pylist())]})

    counted = docs.select(docs[text].alias("text"), trained(docs[key]).alias("teaches")).mapInArrow(count, "slice int, words binary, n long, size long")
    row = counted.groupBy("slice").applyInArrow(merged, "v long, n long, size long").agg(F.sum("n"), F.sum("v"), F.sum("size")).first()
    return tuple(int(x or 0) for x in row)


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast: int = BROADCAST, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row a row of docs.

    Learns from the documents that are not held out.  Words are lower-cased in
    A-Z; each document ends with one more token.  Null and empty texts are that
    token alone.  Repeated rows count and are scored each; other columns are
    left out.  Without training documents all base scores are 0 (each token has
    probability 1 / 1).  Counts for the base score are exact.
    """
    total, vocabulary, size = totals(docs, key, text)
    small = size <= broadcast
    n = labels(docs, max(1, -(-size // SLICE)))
    number = {x: i for i, x in enumerate(n.tolist())}
    own = dealt(docs, key, text, size).withColumn("held_out", ~trained(F.col("doc_id")))
    told = pa.schema([("slice", pa.int32()), ("block", pa.int32()), *((c, pa.binary()) for c in ("words", "word_counts", "grams", "gram_counts"))])
    model = pa.schema([("block", pa.int32()), ("slice", pa.int32()), *((c, pa.binary()) for c in ("counts", "word_levels", "gram_levels", "filter"))])
    sql = lambda s: ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in s)
    rows_of = lambda rows, s: pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [()] * len(s), s)], schema=s)

    def parts(t: pa.Table) -> Tokens:
        return Tokens(*hashed(t, lower=True), len(n))

    def tell(k: tuple, t: pa.Table) -> pa.Table:
        x, block = parts(t), k[0].as_py()
        weight = x.weights(~t.column("held_out").to_numpy())
        words, _, counts = distinct(x.word, weight)
        rows = {s: [s, block, planes(words[a:b], 8), planes(counts[a:b], 4), b"", b""] for s, a, b in cuts(words, n)}
        grams, _, counts = distinct(x.grams, np.concatenate([weight, weight]))
        edge = np.searchsorted(grams, np.arange(len(n) + 1, dtype=np.uint64) << tv.U(8 * WIDTH)).tolist()
        for s, a, b in zip(n.tolist(), edge, edge[1:]):
            if a < b:
                rows.setdefault(s, [s, block, b"", b"", b"", b""])[4:] = planes(grams[a:b], WIDTH), planes(counts[a:b], 4)
        return rows_of(list(rows.values()), told)

    def build(k: tuple, t: pa.Table) -> pa.Table:
        """The slice's part of the filter, and what it says about each block's n-grams."""
        column = lambda c: t.column(c).to_pylist()
        blocks, slice_ = column("block"), k[0].as_py()
        words, n_words = unplaned(column("words"), 8)
        words, word_place, counts = distinct(words, unplaned(column("word_counts"), 4)[0])
        grams, n_grams = unplaned(column("grams"), WIDTH)
        grams, gram_place, gram_counts = distinct(grams | GRAM, unplaned(column("gram_counts"), 4)[0])
        known, seen = counts > 0, gram_counts > 0
        raw = built(np.concatenate([words[known], grams[seen]]), np.concatenate([counts[known], gram_counts[seen]]), bits)
        told_words, told_grams = counts[word_place], b""
        word_levels = b""
        if not small:
            read = Filter(*joined({0: raw}, 1))
            word_levels, told_grams = read.levels(words)[word_place].tobytes(), read.levels(grams)[gram_place].tobytes()
        a, b = np.concatenate(([0], np.cumsum(n_words))).tolist(), np.concatenate(([0], np.cumsum(n_grams))).tolist()
        rows = [(block, slice_, planes(told_words[a[i] : a[i + 1]], 8), word_levels[a[i] : a[i + 1]], told_grams[b[i] : b[i + 1]], b"") for i, block in enumerate(blocks)]
        if small:
            rows.append((-1, slice_, b"", b"", b"", raw))
        return rows_of(rows, model)

    replies = own.groupBy("block").applyInArrow(tell, sql(told)).groupBy("slice").applyInArrow(build, sql(model))
    shared = None
    if small:
        replies = checkpointed(replies)
        shared = docs.sparkSession.sparkContext.broadcast(joined({number[r[0]]: bytes(r[1]) for r in replies.where("block = -1").select("slice", "filter").toLocalIterator()}, len(n)))
        replies = replies.where("block >= 0")

    def score(k: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
        x = parts(left)
        m = len(x.word)
        order = np.argsort(places(n, right.column("slice"))).tolist()
        column = lambda c: (lambda raw: [raw[i] for i in order])(right.column(c).to_pylist())
        words, word_place, _ = distinct(x.word)
        grams, gram_place, _ = distinct(x.grams)
        c = unplaned(column("counts"), 8)[0].astype(np.float64)[word_place]
        if shared is not None:
            read = Filter(*shared.value)
            word_levels = read.levels(words, slice_of(words, len(n)))
            gram_levels = read.levels((grams & KEY) | GRAM, (grams >> tv.U(8 * WIDTH)).astype(np.int64))
        else:
            word_levels, gram_levels = (np.frombuffer(b"".join(column(name)), np.uint8) for name in ("word_levels", "gram_levels"))
        one, grams = LEVELS[word_levels[word_place]], LEVELS[gram_levels[gram_place]]
        two, three = grams[:m], grams[m:]
        after_one, after_two = np.empty(m), np.empty(m)
        after_one[1:], after_two[1:] = one[:-1], two[:-1]
        after_one[x.head] = three[x.head]  # how many texts start
        alone = (c + 1) / (total + vocabulary + 1)
        p = (one + 1) / (total + vocabulary + 1)
        p = (np.minimum(two, after_one) + MASS * p) / (after_one + MASS)
        q = (np.minimum(three, after_two) + MASS * p) / (after_two + MASS)
        q[x.head] = p[x.head]
        per = lambda v: np.add.reduceat(v, x.head)
        columns = [left.column("doc_id"), left.column("held_out"), np.diff(x.at), per((c > 0).astype(np.int64)), np.full(left.num_rows, total), per(np.log10(alone)), per(np.log10(q))]
        return pa.Table.from_arrays([v if isinstance(v, pa.ChunkedArray) else pa.array(v) for v in columns], names=names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]
    made = own.groupBy("block").cogroup(replies.drop("filter").groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return made.withColumnRenamed("doc_id", key)


def op9_bloom_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the model of six sevenths of them."""
    return scored(table(spark, sf_dir, "documents"))
