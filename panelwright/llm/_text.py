"""Vectorised word and n-gram hashing over Arrow string columns.

The delimiters of a word are ASCII, so words can be found on the UTF-8 bytes of
a whole batch at once.  Hashes are polynomial over random byte codes modulo
2**64; the base is odd, hence invertible, so that the hash of any span is one
difference of a prefix sum.  All functions work on slices of bounded size and
keep no state between them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = [9, 10, 11, 12, 13, 32]

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[_SPACE] = False
#: Bytes that begin a code point.
IS_HEAD = (np.arange(256) & 0xC0) != 0x80


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """``run``, after which the worker gives back what memory it no longer uses: workers outlive their tasks, and what one step freed would count against the next."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=2)
def _codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n + 1:
        size = max(n + 1, SLICE + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets) of consecutive rows of at most ``limit`` bytes; one longer row comes alone.  Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    a = 0
    while a < len(column):
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), len(column))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


@dataclass
class Words:
    """Words of a slice in order: byte spans, row of each, and the first word of each row."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = IS_WORD) -> Words:
    """Maximal runs of bytes of the class ``member`` that lie within one row."""
    n, rows = len(data), len(offsets) - 1
    inside = member[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    if n:
        begin[1:] &= ~inside[:-1] | edge[1:n]
        end[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, offsets)
    return Words(starts, np.flatnonzero(end) + 1, np.repeat(np.arange(rows), np.diff(first)), first)


class Hasher:
    """Hashes of byte spans of one slice."""

    def __init__(self, data: np.ndarray, lower: bool):
        up, self._down = _power(len(data))
        self._prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_codes(lower)[data] * up[: len(data)], out=self._prefix[1:])

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._prefix[ends] - self._prefix[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))


def ngrams(hashes: np.ndarray, words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of every n-word window within a row."""
    last = len(hashes) - n + 1
    if last <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    at = np.flatnonzero(words.row[:last] == words.row[n - 1 :])
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        total = total * np.uint64(_BASE) + hashes[at + k]
    return at, mix(total + np.uint64(n))


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets; 0 for empty rows."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
