"""Vectorised work on the UTF-8 bytes of Arrow string columns: words, hashes, sliding minima.

A batch is cut into chunks of about a megabyte at row boundaries, so memory stays
bounded by the chunk (or by the longest single text).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit value per byte, the base of the rolling sums, and multipliers per place of a shingle.
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15 | 3
BASE_INVERSE = pow(BASE, -1, 2**64)
PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * U(2) + U(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            p = np.full(max(n, CHUNK + 4096), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of pieces of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word never crosses a row's edge."""
    solid = ~SPACE[data]
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    start[edge] = solid[edge]
    end[edge - 1] = solid[edge - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, alike wherever the span stands."""
    n = len(data)
    p, q = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * p[:n], out=total[1:])
    return mixed((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte grams, by start."""
    n = len(data)
    p, q = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * p[:n], out=total[1:])
    return mixed((total[k:] - total[:-k]) * q[: n - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by doubling."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < w:
        x = np.minimum(x[: len(x) - (w - span)], x[w - span :])
    return x


def tidy() -> None:
    """Give freed memory back to the system, so that a worker kept for later tasks stays small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with tidy() at its end."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        tidy()

    return whole
