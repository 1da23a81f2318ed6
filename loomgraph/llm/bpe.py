"""Byte-level BPE encoding and decoding.

A pretoken is encoded with a segment tree over its byte positions.  A leaf
holds the rank of the pair that begins at that position (or infinity), an
inner node the leftmost minimum of its two children.  The root therefore names
the next merge; performing it changes three leaves (the merged position, the
one that died, and the live neighbour to the left), each a point update along
one path to the root: O(n log n) for n bytes, however long a run is.

The trees of many pretokens are arrays of one shape and advance together, one
merge a step, so that the work is numpy's; a few very long pretokens advance
one by one.  Equal pretokens are encoded once a batch and kept in a bounded
cache of the worker, found by a hash.  The bytes that a batch's ids decode to
are compared with its texts, and a batch that differs (two pretokens share a
hash) is encoded without the cache.  Texts are split where the
pattern of the public rank files splits them; the classes of code points are
taken from the installed library's own regular expressions, so that both agree
on every code point.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import textvec as tv
from .runtime import table, typed

INF = np.int64(2**62)
#: What the pattern treats as an English ending after an apostrophe.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Bytes from which on a pretoken gets a tree of its own, unless so many others of its size go with it.
OWN_TREE, TOGETHER = 512, 48
#: Encoded pretokens that a worker keeps; beyond that, the cache starts anew.
CACHE_WORDS = 1_500_000

_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """For each code point: 0 other, 1 letter, 2 number, 3 white space (as the library's engine sees them)."""
    global _CLASSES
    if _CLASSES is None:
        import tiktoken

        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, points))
        ranks = {bytes([b]): b for b in range(256)}
        out = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
            found = bytes(tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)).decode()
            out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
        _CLASSES = out
    return _CLASSES


def split(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """True where a pretoken begins. points: code points of documents laid end to end; doc_starts: where they begin."""
    n = len(points)
    kind = classes()[points]
    fresh = np.zeros(n, bool)
    fresh[doc_starts[doc_starts < n]] = True
    run = fresh.copy()  # where a run of one class begins
    run[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(run)
    ends = np.append(starts[1:], n)
    final = np.append(fresh[starts[1:]], True)  # the document ends with the run
    begin = run.copy()
    space = kind[starts] == 3
    # A run of white space before something leaves its last character to what follows.
    cut = space & ~final & (ends - starts > 1)
    begin[ends[cut] - 1] = True
    # A blank as that last character belongs to what follows.
    lent = space & ~final & (points[ends - 1] == 32)
    begin[ends[lent]] = False
    # Endings: an apostrophe alone that nothing has claimed, then the letters.
    for at in starts[(kind[starts] == 0) & (ends - starts == 1) & (points[starts] == 39)]:
        if not begin[at]:
            continue
        for ending in ENDINGS:
            to = at + len(ending)
            if to <= n and not fresh[at + 1 : to].any() and all(points[at + i] == ord(c) for i, c in enumerate(ending)):
                begin[at + 1 : to] = False
                if to < n:
                    begin[to] = begin[to] or kind[to] == 1
                break
    return begin


class Vocabulary:
    """Ranks of a public file: tokens by id, ids of single bytes, and the rank of each pair of ids that makes a token."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, i in ranks.items():
            self.tokens[i] = token
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = np.int64(size)
        pairs = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * size + b] = i
        self.pairs = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self._ranks: dict[int, int] | None = None

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b make, or INF; ids under 0 make none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.made[at], INF)

    def encode(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pretokens data[starts[i]:][:lengths[i]], laid end to end, and how many each has."""
        counts = np.zeros(len(starts), np.int64)
        width = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        order, groups = [], []
        for w in np.unique(width).tolist():
            which = np.flatnonzero(width == w)
            for at in range(0, len(which), max(1, (1 << 20) // w)):
                part = which[at : at + max(1, (1 << 20) // w)]
                if w >= OWN_TREE and len(part) < TOGETHER:
                    one = [self._encode_one(data[a : a + m]) for a, m in zip(starts[part].tolist(), lengths[part].tolist())]
                    ids, n = np.concatenate(one), np.array([len(x) for x in one], np.int64)
                else:
                    ids, n = self._encode(data, starts[part], lengths[part], w)
                counts[part] = n
                order.append(part)
                groups.append(ids)
        if not order:
            return np.zeros(0, np.int64), counts
        flat, who = np.concatenate(groups), np.concatenate(order)
        n = counts[who]
        place = np.empty(len(starts), np.int64)
        place[who] = np.cumsum(n) - n
        return tv.gather(flat, place, counts), counts

    def _encode(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """encode() for pretokens of at most w bytes, w a power of two."""
        n = len(starts)
        place = np.arange(w)
        inside = place < lengths[:, None]
        ids = np.where(inside, self.single[data[np.minimum(starts[:, None] + place, max(len(data) - 1, 0))]], -1) if len(data) else np.full((n, w), -1)
        # Live positions are a doubly linked list; w stands for none on either side.
        right = np.where(place + 1 < lengths[:, None], place + 1, w)
        left = np.broadcast_to(np.where(place > 0, place - 1, w), (n, w)).copy()
        ids = np.concatenate([ids, np.full((n, 1), -1)], 1)
        # A node's key is rank * w + position: the smaller key is the lower rank, then the leftmost.
        tree = np.full((n, 2 * w), INF)
        tree[:, w:-1] = self._key(ids[:, :-2], ids[:, 1:-1], place[:-1], w) if w > 1 else INF
        step = w
        while step > 1:
            half = step // 2
            level = tree[:, step : 2 * step]
            np.minimum(level[:, 0::2], level[:, 1::2], out=tree[:, half:step])
            step = half
        rows = np.arange(n)
        live = rows[tree[:, 1] < INF]
        while len(live):
            key = tree[live, 1]
            at = key % w
            dead = right[live, at]
            after = right[live, dead]
            before = left[live, at]
            ids[live, at] = key // w
            ids[live, dead] = -1
            right[live, at] = after
            some = after < w
            left[live[some], after[some]] = at[some]
            self._update(tree, live, dead, np.full(len(live), INF), w)
            self._update(tree, live, at, self._key(ids[live, at], ids[live, after], at, w), w)
            some = before < w
            who, b = live[some], before[some]
            self._update(tree, who, b, self._key(ids[who, b], ids[who, at[some]], b, w), w)
            live = live[tree[live, 1] < INF]
        ids = ids[:, :w]
        got = ids >= 0
        return ids[got], got.sum(1)

    def _encode_one(self, data: np.ndarray) -> np.ndarray:
        """encode() for one pretoken of two bytes or more."""
        if self._ranks is None:
            self._ranks = dict(zip(self.pairs.tolist(), self.made.tolist()))
        ranks, size, none = self._ranks, int(self.size), int(INF)
        n = len(data)
        bits = (n - 1).bit_length()
        w = 1 << bits
        first = self.single[data]
        level = np.full(w, INF)
        level[: n - 1] = self._key(first[:-1], first[1:], np.arange(n - 1), w)
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][0::2], levels[-1][1::2]))
        tree = [none, *np.concatenate(levels[::-1]).tolist()]
        ids, right, left = first.tolist(), [*range(1, n), -1], list(range(-1, n - 1))

        def put(at: int, key: int) -> None:
            node = at + w
            tree[node] = key
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                if b < a:
                    a = b
                if tree[node] == a:  # nothing changes further up
                    return
                tree[node] = a
                node >>= 1

        def key(a: int, b: int, at: int) -> int:
            rank = ranks.get(a * size + b)
            return none if rank is None else (rank << bits) + at

        while tree[1] < none:
            at, made = tree[1] & (w - 1), tree[1] >> bits
            dead, before = right[at], left[at]
            after = right[at] = right[dead]
            ids[at], ids[dead] = made, -1
            put(dead, none)
            if after >= 0:
                left[after] = at
            put(at, key(made, ids[after], at) if after >= 0 else none)
            if before >= 0:
                put(before, key(ids[before], made, before))
        ids = np.array(ids, np.int64)
        return ids[ids >= 0]

    def _key(self, a: np.ndarray, b: np.ndarray, place: np.ndarray, w: int) -> np.ndarray:
        rank = self.rank(a, b)
        return np.where(rank < INF, rank * w + place, INF)

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, place: np.ndarray, keys: np.ndarray, w: int) -> None:
        """One point update a row, from the leaf to the root."""
        node = place + w
        tree[rows, node] = keys
        while w > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            w >>= 1

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the tokens laid end to end, and the length of each token's."""
        n = self.length[ids]
        return tv.gather(self.bytes, self.start[ids], n), n


class Encoder:
    """Encodes batches of texts; keeps the ids of pretokens it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, where each text's begin (len + 1), the bytes they decode to and each id's number of bytes."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at_byte = np.flatnonzero((data & 0xC0) != 0x80)  # where each code point begins
        doc_point = np.searchsorted(at_byte, offsets[:-1])
        starts = at_byte[np.flatnonzero(split(points, doc_point))]
        ends = np.append(starts[1:], len(data))
        keys = tv.spans_hash(data, starts, ends)
        unique, sample, inverse = np.unique(keys, return_index=True, return_inverse=True)
        place = self._known(unique)
        new = np.flatnonzero(place < 0)
        if len(new):
            ids, counts = self.v.encode(data, starts[sample[new]], (ends - starts)[sample[new]])
            if len(self.keys) + len(new) > CACHE_WORDS:
                self._forget()
                new = np.arange(len(unique))
                ids, counts = self.v.encode(data, starts[sample], (ends - starts)[sample])
            first = np.cumsum(counts) - counts + len(self.ids)
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            keys = np.concatenate([self.keys, unique[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.first, self.count = keys[order], np.concatenate([self.first, first])[order], np.concatenate([self.count, counts])[order]
            place = self._known(unique)
        where = place[inverse]
        n = self.count[where]
        token = np.searchsorted(starts, offsets)
        ids = tv.gather(self.ids, self.first[where], n)
        back, size = self.v.decode(ids)
        if not np.array_equal(back, data):  # different pretokens of one hash
            ids, n = self.v.encode(data, starts, ends - starts)
            ids = ids.astype(np.int32)
            back, size = self.v.decode(ids)
        return ids, np.concatenate(([0], np.cumsum(n)))[token], back, size

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a rank file; the file is part of the installed tokenizers, not of the data."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary.load(path))
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array of int) of each text. Null or empty text: an empty array. One row a row of docs; other columns are left out."""
    return _mapped(docs, path, key, text, T.ArrayType(T.IntegerType()), "ids", pa.list_(pa.int32()), lambda e, d, o: (lambda ids, at, *_: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))(*e.batch(d, o)))


def decode(coded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the text's bytes (binary) of each array of ids. Null: empty. Bytes need not be UTF-8 when ids were cut."""
    schema = pa.schema([("key", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(path).v
        for b in batches:
            lists = b.column(1)
            made = []
            for row in lists:
                made.append(v.decode(np.array(row.as_py() or [], np.int64))[0].tobytes())
            yield from typed([{"key": b.column(0), "bytes": made}], schema)

    return coded.select(coded[key].cast("long").alias("key"), coded[ids]).mapInArrow(run, "key long, bytes binary").withColumnRenamed("key", key)


def _mapped(docs: DataFrame, path: str, key: str, text: str, kind: T.DataType, name: str, arrow: pa.DataType, f) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("value", arrow)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b, data, offsets in tv.pieces(batches, "text"):
            yield from typed([{"key": b.column(0), "value": f(e, data, offsets)}], schema)

    out = T.StructType([T.StructField("key", T.LongType()), T.StructField("value", kind)])
    return docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")).mapInArrow(run, out).withColumnsRenamed({"key": key, "value": name})


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Round trip of each text: key, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256 (bytes decoded from the ids).

    Null text counts as empty: no tokens and the digests of nothing.  A null
    key stays null, repeated rows stay repeated, other columns are left out,
    an empty table gives an empty result.  Texts are whole, in slices of about
    half a MB (or one longer text); a worker holds some tens of times a slice.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b, data, offsets in tv.pieces(batches, "text"):
            ids, at, back, n = e.batch(data, offsets)
            edge = np.concatenate(([0], np.cumsum(n)))[at]
            ids, back = memoryview(ids.astype("<u4").tobytes()), memoryview(back.tobytes())
            row = {"doc_id": b.column(0), "n_tokens": np.diff(at)}
            row["ids_sha256"] = [hashlib.sha256(ids[4 * i : 4 * j]).hexdigest() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            row["decoded_sha256"] = [hashlib.sha256(back[i:j]).hexdigest() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]
            yield from typed([row], schema)

    made = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return made.withColumnRenamed("doc_id", key)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, encoded and decoded by the public ranks for many languages."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
