"""Vectorised views of Arrow string columns: bytes, words, lines and their hashes.

A column is cut into slices of about ``SLICE_BYTES`` of text, so that memory
depends on the slice (or on the longest single text) and not on the batch.
Nulls count as empty texts. All hashes are functions of bytes alone, so that
every executor, retry and run agrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))

#: The separators of a word: space and the five controls from tab to carriage return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_KEY = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BYTE_KEY_LOWER = BYTE_KEY.copy()
BYTE_KEY_LOWER[65:91] = BYTE_KEY[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BASE_INV)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64, at least n of each."""
    size = 1 << 20
    while size < n:
        size *= 2
    return _powers(size)


def prefix_hash(keys: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = the sum of keys[k] * base**k for i <= k < j."""
    out = np.empty(len(keys) + 1, np.uint64)
    out[0] = 0
    np.cumsum(keys * powers(len(keys) + 1)[0][: len(keys)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans, equal for equal contents wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


class Slice:
    """Consecutive texts of a column as one byte buffer.

    data: the bytes of all texts; starts, ends: each text's bounds in data;
    lo, hi: the rows of the column that it holds.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        self.data = data[offsets[lo] : offsets[hi]]
        at = (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64)
        self.starts, self.ends = at[:-1], at[1:]

    def __len__(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word; no word crosses texts."""
        n = len(self.data)
        if not n:
            zero = np.zeros(0, np.int64)
            return zero, zero, zero
        inside = np.empty(n + 1, bool)
        np.logical_not(SEPARATOR[self.data], out=inside[:n])
        inside[n] = False
        edge = np.zeros(n + 1, bool)
        edge[self.starts] = True
        edge[n] = True
        first = inside[:n].copy()
        first[1:] &= ~inside[: n - 1] | edge[1:n]
        last = inside[:n] & (~inside[1:] | edge[1:])
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, self.owner(start)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text number of each (ascending) position."""
        upto = np.searchsorted(at, self.ends)
        return np.repeat(np.arange(len(self)), np.diff(upto, prepend=0))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of the pieces between line feeds; an empty text has one."""
        feed = np.flatnonzero(self.data == 10)
        start = np.concatenate([self.starts, feed + 1])
        end = np.concatenate([self.ends, feed])
        owner = np.concatenate([np.arange(len(self)), self.owner(feed)])
        # a piece's start and the next feed pair up after sorting within the text
        by_start, by_end = np.lexsort((start, owner)), np.lexsort((end, owner))
        return start[by_start], end[by_end], owner[by_start]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column in slices of at most limit bytes, or of one longer text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    n = len(column)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        # empty texts must not make one slice of countless rows
        hi = min(hi, n, lo + 65536)
        yield Slice(data, offsets, lo, hi)
        lo = hi


def per_text(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights, n)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
