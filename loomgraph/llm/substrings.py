"""Removal of long passages that occur more than once anywhere in the corpus.

The reference is the corpus itself, so broadcasting automata of all of it to
every document would cost the square of its size.  Instead each window of words
is tied to one short gram inside it, its minimizer, and both the reference and
the streams are dealt to shards by that gram: equal windows have equal
minimizers, so a window can only match inside its own shard.

1.  Each block of documents tells the slices its minimizers; those that occur
    once in the corpus are dropped.
2.  What is left are spans: the words of consecutive windows that share a
    minimizer.  Equal spans of a block travel once, with their number.  A
    minimizer that is very frequent is split further, window by window.
3.  A shard builds a suffix automaton of its spans and counts how often each
    state's words occur.  It streams the spans through the automaton for
    matching statistics, cut to the window's length: the state then reached
    says whether the window occurs twice.
4.  The blocks get one bit a window back, and remove what is covered.

Words are compared by all 64 bits of their hash, one by one: a wrong removal
takes two different words that share a hash (about 2**-64 a pair of words).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .blocks import cuts, dealt, hashed, laid, places, size_of, slices
from .runtime import table

#: Words in a window.
WINDOW = 35
#: Occurrences of a minimizer from which its windows go to shards of their own.
FREQUENT = 4096
#: Words of an automaton after which a shard starts the next one (groups of one minimizer stay whole).
AUTOMATON = 100_000


class SuffixAutomaton:
    """Of several strings of integers, each with a number of occurrences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def add(self, string: list[int], times: int) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in string:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, q, c)
            else:
                new = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                count.append(0)
                p = last
                while p >= 0:
                    n = nxt[p]
                    q = n.get(c)
                    if q is not None:
                        link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
                        break
                    n[c] = new
                    p = link[p]
                last = new
            count[last] += times

    def close(self) -> None:
        """Sums the occurrences up along the suffix links."""
        count, link = self.count, self.link
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if link[v] > 0:
                count[link[v]] += count[v]

    def repeated(self, string: list[int], window: int) -> int:
        """A bit for each window of the string, from the left: whether it occurs twice or more. The string must have been added."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        v, bits = 0, 0
        for end, c in enumerate(string, 1):
            v = nxt[v][c]
            while length[link[v]] >= window:
                v = link[v]
            if end >= window and count[v] > 1:
                bits |= 1 << (end - window)
        return bits


class Spans:
    """The windows of a block's texts and their minimizers."""

    def __init__(self, t: pa.Table, window: int):
        self.window, self.gram = window, window // 2 + 1
        self.h, self.first = hashed(t)
        n = len(self.h)
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        m = max(0, n - window + 1)
        self.at = np.flatnonzero(doc[:m] == doc[window - 1 :]) if m else np.zeros(0, np.int64)  # first words of windows
        grams = self.grams = tv.grams_hash(self.h, self.gram)
        width = window - self.gram + 1
        low, done = grams, 1
        while done < width:  # smallest gram of each run of so many
            step = min(done, width - done)
            low = np.minimum(low[: len(low) - step], low[step:])
            done += step
        low = low[self.at]
        place = np.zeros(len(self.at), np.int64)
        for o in range(width - 1, -1, -1):  # the leftmost
            place[grams[self.at + o] == low] = o
        self.place = self.at + place
        self.key = tv.mix(low)  # minima are small numbers; slices are dealt by the first bits
        self.keys, self.inverse = np.unique(self.key, return_inverse=True)

    def occurrences(self) -> np.ndarray:
        """How many places in the block each of keys is the minimizer of some window at."""
        new = np.ones(len(self.at), bool)
        new[1:] = self.place[1:] != self.place[:-1]
        return np.bincount(self.inverse[new], minlength=len(self.keys))

    def cut(self, kinds: np.ndarray) -> None:
        """Spans of the windows whose minimizer is repeated (kind 1) or frequent (2), distinct ones in order."""
        kind = kinds[self.inverse] if len(self.at) else np.zeros(0, np.uint8)
        start = np.ones(len(self.at), bool)
        start[1:] = (self.place[1:] != self.place[:-1]) | (self.at[1:] != self.at[:-1] + 1) | (kind[1:] == 2)
        ids = np.cumsum(start) - 1
        windows = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        head = np.flatnonzero(start)
        good = kind[head] > 0
        head, self.windows = head[good], windows[good]
        self.start = self.at[head]
        self.words = self.windows + self.window - 1
        # Grams at the start, at the end of the first window and at the end cover the span.
        g, last = self.grams, self.start + self.words - self.gram
        content = tv.mix(tv.mix(g[self.start] * tv.U(0xD6E8FEB86659FD93) + g[self.start + self.window - self.gram]) * tv.U(0x9E3779B97F4A7C15) + g[last] + self.words.astype(np.uint64)) if len(head) else np.zeros(0, np.uint64)
        key = np.where(kind[head] == 2, content, self.key[head])
        order = np.lexsort((content, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.sample = order[new]
        self.span_keys = key[self.sample]
        self.times = np.bincount(self.which, minlength=len(self.sample))


def marked(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), prefix: str = "", verbatim: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words, one blank between) and the columns keep, their names after prefix, one row a row of docs.

    With verbatim, a text that loses no word is returned as it is, white space
    and null included.

    Words are the bytes between white space, unchanged.  A null or empty text
    has no words; texts of fewer words than the window lose none.  Repeated
    rows are documents like any others: what they share is removed from each.
    An empty table gives an empty result.
    """
    if not 2 <= window <= 62:
        raise ValueError("a window has from 2 to 62 words")
    size = size_of(docs, text)
    n = slices(docs, size)
    own = dealt(docs, key, text, size, keep)
    told = pa.schema([("slice", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())])
    answer = pa.schema([("block", pa.int32()), ("slice", pa.int32()), ("kinds", pa.binary())])
    sent = pa.schema([("slice", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("times", pa.binary()), ("windows", pa.binary()), ("words", pa.binary())])
    back = pa.schema([("block", pa.int32()), ("slice", pa.int32()), ("bits", pa.binary())])
    sql = lambda s: ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in s)

    def minimizers(k: tuple, t: pa.Table) -> pa.Table:
        s = Spans(t, window)
        times = np.minimum(s.occurrences(), 65535).astype("<u2")
        rows = [(c, k[0].as_py(), s.keys[a:b].tobytes(), times[a:b].tobytes()) for c, a, b in cuts(s.keys, n)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 4, told)], schema=told)

    def counted(k: tuple, t: pa.Table) -> pa.Table:
        keys, lengths = laid(t.column("keys"), "<u8")
        times, _ = laid(t.column("times"), "<u2")
        _, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, weights=times)[inverse]
        kinds = ((total > 1).astype(np.uint8) + (total > FREQUENT)).astype(np.uint8).tobytes()
        ends = np.cumsum(lengths).tolist()
        return pa.Table.from_arrays([t.column("block"), t.column("slice"), pa.array([kinds[b - a : b] for a, b in zip(lengths.tolist(), ends)], pa.binary())], schema=answer)

    def kinds_of(s: Spans, right: pa.Table) -> np.ndarray:
        return laid(right.column("kinds"), "u1", np.argsort(places(n, right.column("slice"))))[0]

    def spans(k: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        s = Spans(left, window)
        kinds = kinds_of(s, right)
        s.cut(kinds)
        start, words = s.start[s.sample], s.words[s.sample]
        content = tv.gather(s.h, start, words).astype("<u8")
        ends = np.concatenate(([0], np.cumsum(words)))
        times, windows = np.minimum(s.times, 255).astype(np.uint8), s.windows[s.sample].astype(np.uint8)
        rows = [(c, k[0].as_py(), s.span_keys[a:b].tobytes(), times[a:b].tobytes(), windows[a:b].tobytes(), content[ends[a] : ends[b]].tobytes()) for c, a, b in cuts(s.span_keys, n)]
        # The kinds go along to the last pass, which then need not ask again, in a group of their own.
        rows.append((-1 - k[0].as_py(), k[0].as_py(), kinds.tobytes(), b"", b"", b""))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), sent)], schema=sent)

    def matched(k: tuple, t: pa.Table) -> pa.Table:
        if k[0].as_py() < 0:
            return pa.Table.from_arrays([t.column("block"), t.column("slice"), t.column("keys")], schema=back)
        keys, lengths = laid(t.column("keys"), "<u8")
        times, _ = laid(t.column("times"), "u1")
        windows, _ = laid(t.column("windows"), "u1")
        raw = b"".join(t.column("words").to_pylist())
        ends = np.cumsum((windows.astype(np.int64) + window - 1) * 8)
        order = np.argsort(keys, kind="stable")
        starts = (ends - (windows.astype(np.int64) + window - 1) * 8).tolist()
        ends = ends.tolist()
        edge = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1], [True]))).tolist()
        bits = np.zeros(len(keys), np.uint64)
        held: list[tuple[bytes, int, list[int]]] = []
        size = 0

        def stream() -> None:
            machine = SuffixAutomaton()
            strings = []
            for content, many, _ in held:
                strings.append(np.frombuffer(content, "<u8").tolist())
                machine.add(strings[-1], many)
            machine.close()
            for string, (*_, members) in zip(strings, held):
                bits[members] = machine.repeated(string, window)

        for a, b in zip(edge, edge[1:]):
            group: dict[bytes, list[int]] = {}
            for i in order[a:b].tolist():
                group.setdefault(raw[starts[i] : ends[i]], []).append(i)
            if len(group) == 1:  # one string: each of its windows occurs as often as it does
                members = order[a:b]
                if times[members].sum() > 1:
                    bits[members] = (tv.U(1) << windows[members].astype(np.uint64)) - tv.U(1)
                continue
            for content, members in group.items():
                held.append((content, int(times[members].sum()), members))
                size += len(content) // 8
            if size > AUTOMATON:
                stream()
                held, size = [], 0
        if held:
            stream()
        raw_bits, at = bits.astype("<u8").tobytes(), np.cumsum(lengths).tolist()
        return pa.Table.from_arrays([t.column("block"), t.column("slice"), pa.array([raw_bits[8 * (b - a) : 8 * b] for a, b in zip(lengths.tolist(), at)], pa.binary())], schema=back)

    names = [f"keep_{c}" for c in keep]

    def removed(k: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        s = Spans(left, window)
        order = np.argsort(places(n, right.column("slice")))
        own_kinds = right.column("bits").to_pylist()[order[0]] if len(order) else b""
        s.cut(np.frombuffer(own_kinds, np.uint8))
        bits = laid(right.column("bits"), "<u8", order[1:])[0][s.which]
        cover = np.zeros(len(s.h) + 1, np.int64)
        for j in range(int(s.windows.max(initial=0))):
            hit = s.start[(bits >> tv.U(j)) & tv.U(1) == 1] + j
            cover += np.bincount(hit, minlength=len(cover)) - np.bincount(hit + window, minlength=len(cover))
        gone = np.cumsum(cover[:-1]) > 0
        kept: list[bytes] = []
        base = 0
        for _, data, offsets in tv.pieces(left.select(["text"]).to_batches()):
            a, b, first = tv.words(data, offsets)
            stay = np.flatnonzero(~gone[base : base + len(a)])
            base += len(a)
            size = b[stay] - a[stay] + 1
            ends = np.concatenate(([0], np.cumsum(size)))
            out = tv.gather(np.append(data, np.uint8(32)), a[stay], size).copy()
            out[ends[1:] - 1] = 32
            out, edge = out.tobytes(), ends[np.searchsorted(stay, first)].tolist()
            kept += [out[i : max(i, j - 1)] for i, j in zip(edge, edge[1:])]
        lost = np.concatenate(([0], np.cumsum(gone)))[s.first]
        texts = [x.decode() for x in kept]
        if verbatim:
            texts = [new if n else old for new, n, old in zip(texts, np.diff(lost).tolist(), left.column("text").to_pylist())]
        columns = [left.column("doc_id"), pa.array(np.diff(s.first)), pa.array(np.diff(lost)), pa.array(texts, pa.string())]
        return pa.Table.from_arrays([*columns, *(left.column(c) for c in names)], names=["doc_id", "n_words", "n_removed", "kept", *names])

    asked = own.groupBy("block").applyInArrow(minimizers, sql(told)).groupBy("slice").applyInArrow(counted, sql(answer))
    shards = own.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(spans, sql(sent)).groupBy("slice").applyInArrow(matched, sql(back))
    kind = own.select(F.col("doc_id"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept"), *names).schema
    made = own.groupBy("block").cogroup(shards.groupBy("block")).applyInArrow(removed, kind)
    return made.withColumnsRenamed({"doc_id": key} | {f"keep_{c}": f"{prefix}{c}" for c in keep})


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that occur elsewhere."""
    made = marked(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
