"""Vectorised text primitives over Arrow buffers.

The corpus operators spend their time on words, not on rows, so they read the
UTF-8 buffer of an Arrow column as one numpy byte array and find words, word
hashes and k-gram hashes with array operations.  No Python string is made for
a word.

A word's hash mixes its bytes in eight at a time, a gram's hash mixes those of
its halves; after each step a bijective finisher spreads every bit, so that no
arithmetic relation between inputs survives (sums of powers have such
relations: strings of the Thue-Morse form are equal under any base).  Words of
one length up to eight bytes never share a hash, other pairs do with a
probability of about 2**-64.  The constants are public, so an author who knows
them can make two words that collide; where a wrong match would change an
output, the callers compare bytes.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Words are runs of bytes outside this set: blank, and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, any other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SEED, _STEP, _LEFT = U(0x243F6A8885A308D3), U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: Bytes of a word from which on its hash is a digest's.
LONG = 128
#: The last 0 to 8 bytes of a little-endian word.
_FIRST = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], U)
_LIBC = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads every bit of x."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]] (bytes)."""
    if not len(starts):
        return np.zeros(0, U)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
    n = ends - starts
    h = mix((n.astype(U) * _STEP + _SEED) ^ (eight[starts] & _FIRST[np.minimum(n, 8)]))
    live, done = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(live):
        left = n[live] - done
        h[live] = mix((h[live] + _STEP) ^ ((eight[starts[live] + done] & _FIRST[np.minimum(left, 8)]) * _LEFT))
        live, done = live[left > 8], done + 8
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def grams_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbours of h; the caller drops those that cross documents."""
    if len(h) < k:
        return np.zeros(0, U)
    g, done = h, 1  # hashes of runs of done; a run is that of its halves, and one more where k is odd
    for odd in bin(k)[3:]:
        g = mix(g[: len(g) - done] * _LEFT + g[done:])
        done *= 2
        if odd == "1":
            g = mix(g[:-1] * _STEP + h[done : done + len(g) - 1])
            done += 1
    return mix(g + U(k))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _trim() -> None:
    """Gives freed memory back to the system, where the C library can; a worker serves many tasks, and its free lists only grow."""
    global _LIBC
    if _LIBC is None:
        try:
            _LIBC = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):
            _LIBC = lambda _: 0
    _LIBC(0)


def pieces(batches, text: str = "text", limit: int = 1 << 19, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about limit bytes of text (or one longer document) and at most so many rows: slice, bytes, offsets."""
    for batch in batches:
        data, offsets = buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
        _trim()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (len + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = np.empty(n + 1, bool)
    np.take(SPACE, data, out=gap[:n])
    gap[n] = True
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(~gap[:n] & (first[:n] | np.concatenate(([True], gap[: n - 1]))))
    ends = np.flatnonzero(~gap[:n] & (first[1:] | gap[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the index of each document's first word (len + 1)."""
    if lower:
        data = LOWER[data]
    starts, ends, first = words(data, offsets)
    return spans_hash(data, starts, ends), first


def joined(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of these lengths laid end to end: the piece of each element, and its place there."""
    piece = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    return piece, np.arange(len(piece)) - np.repeat(ends - lengths, lengths)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i]:starts[i] + lengths[i]] for all i, laid end to end."""
    if not len(starts):
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]
