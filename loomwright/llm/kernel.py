"""Vectorised word splitting over Arrow string buffers.

All functions work on whole texts. Rows are taken in slices of about SLICE bytes, so that memory
is bounded by the largest single text and not by the Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 512 << 10
#: Odd multiplier of the polynomial word hash, modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_byte = np.arange(256)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
#: Letters, digits and everything beyond ASCII.
ALNUM = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
#: Everything but ASCII white space.
NONSPACE = ~((_byte == 32) | ((_byte >= 9) & (_byte <= 13)))

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0..n and BASE^-0..-n modulo 2^64; kept for the life of the worker, up to 2 * SLICE."""
    if len(_powers[0]) > n:
        return _powers[0][: n + 1], _powers[1][: n + 1]
    size = max(n + 1, SLICE + 1)
    out = []
    for b in (BASE, BASE_INVERSE):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if size <= 2 * SLICE:
        _powers[:] = out
    return out[0][: n + 1], out[1][: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some rows: row r has words first[r]:first[r + 1], word w is low[start[w]:end[w]]."""

    __slots__ = ("low", "start", "end", "first", "hash")

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, in_word: np.ndarray, hashed: bool = True):
        n = len(raw)
        inside = in_word[raw]
        self.low = LOWER[raw]
        inner = bounds[(bounds > 0) & (bounds < n)]
        change = np.empty(n + 1, bool)
        if n:
            change[0], change[n] = inside[0], inside[-1]
            np.not_equal(inside[1:], inside[:-1], out=change[1:n])
            cut = inner[inside[inner] & inside[inner - 1]]  # a word that two rows share
        else:
            change[:] = False
            cut = inner
        edges = np.flatnonzero(change)
        self.start, self.end = edges[::2], edges[1::2]
        if len(cut):
            cut = np.unique(cut)
            self.start = np.sort(np.concatenate([self.start, cut]))
            self.end = np.sort(np.concatenate([self.end, cut]))
        self.first = np.searchsorted(self.start, bounds)
        if hashed:
            up, down = powers(n)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by one space."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j], strict=True))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.empty(0, np.uint8)
    return raw, bounds - bounds[0]


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of consecutive rows of about `size` bytes."""
    raw, bounds = buffers(column)
    n, i = len(bounds) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, side="right")) - 1)
        yield i, j, raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


@lru_cache(1)
def _trim():  # noqa: ANN202
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def relax() -> None:
    """Give freed memory back to the system: a worker lives on for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def texts(column: pa.Array) -> list[str]:
    """Python strings; null rows are empty."""
    return column.fill_null("").to_pylist()
