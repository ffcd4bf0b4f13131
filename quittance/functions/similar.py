"""Similarity of many pairs of canonical texts at once, in 64-bit lanes.

A longest common subsequence needs one addition and four bit operations per character
of the second text; numpy does that for all pairs of a batch, and for all windows of
the second text as a second axis.  Before windows are looked at, the subsequence of
the whole texts says how high a pair can score at all.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quittance.functions.text import SHORTEST_NEEDLE, canonical, similarity

#: Bits of a lane: longer needles are compared one by one.
LANES = 64
#: Lane operations that a step holds in memory.
CELLS = 1 << 20


def codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points padded with zeros, lengths)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    wide = int(lengths.max(initial=1)) or 1
    return np.array(texts, dtype=f"U{wide}").view(np.uint32).reshape(len(texts), wide), lengths


def full(n: np.ndarray) -> np.ndarray:
    """n low bits set."""
    return np.where(n >= LANES, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(n, LANES - 1).astype(np.uint64)) - np.uint64(1))


def masks(needle: np.ndarray, hay: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For every pair and place of hay, the places of the needle with the same character."""
    out = np.zeros(hay.shape, np.uint64)
    for k in range(min(needle.shape[1], LANES)):
        same = (hay == needle[:, k : k + 1]) & (k < n)[:, None]
        out |= same.astype(np.uint64) << np.uint64(k)
    return out


def ceiling(common: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best score of any window if the whole texts have so much in common: a window of just that."""
    return 200.0 * common / np.maximum(n + common, 1)


def whole_common(mask: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Longest common subsequence of the needle and the whole text."""
    state = np.full(len(mask), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(mask.shape[1]):
        u = state & mask[:, j]
        state = (state + u) | (state - u)
    return n - np.bitwise_count(state & full(n)).astype(np.int64)


def best_windows(mask: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    """Best 200 * common / (lengths) over the windows of n places of texts of lengths m, shorter windows at the ends included.

    mask: of pairs whose needles all have n characters.
    """
    pairs, wide = mask.shape
    count = wide + n - 1  # windows begin at 1 - n and later
    padded = np.zeros((pairs, wide + 2 * (n - 1)), np.uint64)
    padded[:, n - 1 : n - 1 + wide] = mask
    state = np.full((pairs, count), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for t in range(n):
        u = state & padded[:, t : t + count]
        state = (state + u) | (state - u)
    common = n - np.bitwise_count(state & full(np.int64(n))).astype(np.int64)
    begin = np.arange(1 - n, wide)[None, :]
    length = np.minimum(begin + n, m[:, None]) - np.maximum(begin, 0)
    return np.where(length > 0, 200.0 * common / np.maximum(n + length, 1), 0.0).max(1)


def _one_way(needles: list[str], hays: list[str], least: int) -> np.ndarray:
    """Best windows of needles of at most LANES characters in hays; 0 where least is out of reach."""
    out = np.zeros(len(needles))
    a, n = codes(needles)
    b, m = codes(hays)
    mask = masks(a, b, n)
    left = np.flatnonzero(ceiling(whole_common(mask, n), n) >= max(least, 1))
    for size in np.unique(n[left]):
        own = left[n[left] == size]
        step = max(1, CELLS // (b.shape[1] + int(size)))
        for k in range(0, len(own), step):
            part = own[k : k + step]
            out[part] = best_windows(mask[part][:, : int(m[part].max())], int(size), m[part])
    return out


def scores(needles: Sequence[str], hays: Sequence[str], least: int = 0) -> np.ndarray:
    """similarity() of pairs of texts in canonical form, 0 to 100; where it is below least, any number below least."""
    out = np.zeros(len(needles), np.int32)
    usable = [k for k, (a, b) in enumerate(zip(needles, hays, strict=True)) if len(a) >= SHORTEST_NEEDLE and b]
    short, long = [], []
    for k in usable:
        a, b = needles[k], hays[k]
        if len(a) > len(b):
            a, b = b, a
        if len(a) > LANES:
            out[k] = similarity(needles[k], hays[k])
        elif len(a) == len(b):
            short.append((k, a, b))
            short.append((k, b, a))
        else:
            short.append((k, a, b))
    short.sort(key=lambda x: len(x[2]))  # texts of like lengths are padded alike
    while short:
        wide = len(short[-1][2])
        step = max(1, CELLS // (4 * wide))
        long = short[-step:]
        del short[-step:]
        at = np.array([x[0] for x in long])
        np.maximum.at(out, at, _one_way([x[1] for x in long], [x[2] for x in long], least).astype(np.int32))
    return out


def similar_in_block(needles: Sequence[str], hays: Sequence[str], least: int) -> list[tuple[int, int, int]]:
    """(needle, hay, score) of all pairs that reach least, each needle no longer than its hay.

    The character masks of needles are built once for the whole block.
    """
    a, n = codes(needles)
    b, m = codes(hays)
    known, place = np.unique(a, return_inverse=True)
    table = np.zeros((len(needles), len(known) + 1), np.uint64)
    place = place.reshape(a.shape)
    for k in range(min(a.shape[1], LANES)):
        rows = np.flatnonzero(k < n)
        table[rows, place[rows, k]] |= np.uint64(1) << np.uint64(k)
    found = np.minimum(np.searchsorted(known, b), len(known) - 1)
    found = np.where((known[found] == b) & (np.arange(b.shape[1]) < m[:, None]), found, len(known))
    state = np.full((len(needles), len(hays)), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(b.shape[1]):
        u = state & table[:, found[:, j]]
        state = (state + u) | (state - u)
    common = n[:, None] - np.bitwise_count(state & full(n)[:, None]).astype(np.int64)
    first, second = np.nonzero((ceiling(common, n[:, None]) >= max(least, 1)) & (n[:, None] <= m[None, :]) & (n <= LANES)[:, None])
    long = [(i, j) for i in np.flatnonzero(n > LANES) for j in np.flatnonzero(m >= n[i])]
    pairs = [*zip(first.tolist(), second.tolist(), strict=True), *long]
    reached = scores([hays[j] for _, j in pairs], [needles[i] for i, _ in pairs], least)  # the longer first: only it must not be short
    return [(int(i), int(j), int(s)) for (i, j), s in zip(pairs, reached, strict=True) if s >= least]


def similarity_above(least: int):
    """Column function of two texts: their similarity where it is least or more, else any number below least."""

    @F.pandas_udf(T.IntegerType())
    def similarity_from(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(scores([canonical(x or "") for x in a], [canonical(x or "") for x in b], least), dtype="int32")

    return similarity_from


#: Column function of two texts: their similarity, 0 to 100.
similarity_of = similarity_above(0)
