"""Vectorised views of Arrow text columns: flat bytes, words, lines and their 64-bit hashes.

A null text is an empty text. Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r,
which is the same on code points, since those bytes never occur inside a UTF-8 sequence.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_KEYS = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
WORD_KEYS = _rng.integers(0, 2**63, 64, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _place_keys(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


PLACES = _place_keys(1 << 14)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory of Arrow and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has at most ``most`` bytes of text, or a single row."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to
    give_back()  # the process serves other tasks, too


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets; empty ranges give 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at row offsets."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Multilinear 64-bit hashes of the byte ranges [starts, ends), which may not be empty."""
    length = ends - starts
    if not len(length):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(begin, length)
    keys = PLACES if int(length.max()) <= len(PLACES) else _place_keys(int(length.max()))
    part = BYTE_KEYS[data[place + np.repeat(starts, length)]]
    part = (part ^ (part >> U(29))) * keys[place]
    return mix(np.add.reduceat(part, begin) + length.astype(np.uint64) * U(0x9E3779B97F4A7C15))


class Words:
    """The words of all rows of a text column: starts, ends, row and hash of each; offsets by row."""

    def __init__(self, col: pa.Array, table: np.ndarray | None = None, hashed: bool = True):
        """``table`` maps bytes before words are found, as to lower case."""
        self.data, self.offsets = flat(col)
        if table is not None:
            self.data = table[self.data]
        self.inside = ~SPACE[self.data]
        self.starts, self.ends = runs(self.inside, self.offsets)
        self.at = np.searchsorted(self.starts, self.offsets)
        self.row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.at))
        self.hash = hashes(self.data, self.starts, self.ends) if hashed else None

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each n-word window that lies in one row."""
        k = len(self.starts) - n + 1
        if k <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.row[: k] == self.row[n - 1 :])
        h = np.zeros(len(first), np.uint64)
        for i in range(n):
            h += self.hash[first + i] * WORD_KEYS[i]
        return first, mix(h)
