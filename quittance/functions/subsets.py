"""Bounded subset sums and fair division, in whole cents."""

from __future__ import annotations

from itertools import combinations

import numpy as np


def find_subsets(amounts: list[int], target: int, upper: int, most: int = 4, budget: int = 50_000, results: int = 16, least: int = 2) -> tuple[list[tuple[int, ...]], bool]:
    """(index tuples whose sums lie in [target, upper], whether the budget ran out).

    Depth first, larger amounts first, indexes breaking ties.  The search ends at
    ``results`` finds, which is no truncation.  Tuples ascend and are sorted by size,
    then index.
    """
    if least < 1:
        raise ValueError("subsets have at least one member")
    if any(a <= 0 for a in amounts):
        raise ValueError("amounts must be positive")
    rank = sorted(range(len(amounts)), key=lambda i: (-amounts[i], i))
    value = [amounts[i] for i in rank]
    n = len(value)
    reach = [0] * (n + 1)
    for k in reversed(range(n)):
        reach[k] = reach[k + 1] + value[k]
    found: set[tuple[int, ...]] = set()
    spent, total = 0, 0
    picked: list[int] = []
    # next position to try at each depth; a depth is left when it is exhausted
    frontier = [0]
    while frontier:
        k = frontier[-1]
        if k >= n or len(picked) >= most:
            over = True
        else:
            spent += 1
            if spent > budget:
                return _in_order(found), True
            over = total + reach[k] < target
        if over:
            frontier.pop()
            if picked:
                total -= value[picked.pop()]
            continue
        frontier[-1] = k + 1
        if total + value[k] > upper:
            continue
        picked.append(k)
        total += value[k]
        if len(picked) >= least and total >= target:
            found.add(tuple(sorted(rank[p] for p in picked)))
            if len(found) >= results:
                break
        if len(picked) < most and k + 1 < n and total + reach[k + 1] >= target:
            frontier.append(k + 1)
        else:
            total -= value[picked.pop()]
    return _in_order(found), False


def _in_order(found: set[tuple[int, ...]]) -> list[tuple[int, ...]]:
    return sorted(found, key=lambda s: (len(s), s))


#: Rows of more amounts are not added up side by side, and so many sums are held at a time.
_SIDE_BY_SIDE, _SUMS = 12, 1 << 20


def some_add_up(rows: list[list[int]], targets: list[int], uppers: list[int], most: int = 4) -> list[bool]:
    """Whether 2 to most amounts of each row add up into [target, upper]; true, too, of rows too long to try."""
    worth = np.array([len(r) > _SIDE_BY_SIDE for r in rows], dtype=bool)
    sizes, low, high = np.array([len(r) for r in rows]), np.array(targets, dtype=np.int64), np.array(uppers, dtype=np.int64)
    for n in {int(n) for n in sizes if 2 <= n <= _SIDE_BY_SIDE}:
        picks = [np.array(list(combinations(range(n), k))) for k in range(2, min(most, n) + 1)]
        mine = np.flatnonzero(sizes == n)
        step = max(1, _SUMS // sum(p.size for p in picks))
        for at in range(0, len(mine), step):
            some = mine[at : at + step]
            amounts, least, upper = np.array([rows[i] for i in some], dtype=np.int64), low[some, None], high[some, None]
            for p in picks:
                sums = amounts[:, p].sum(axis=2)
                worth[some] |= ((sums >= least) & (sums <= upper)).any(axis=1)
    return worth.tolist()


def apportion(amount: int, weights: list[int]) -> list[int]:
    """Parts of amount in proportion to weights that sum up to it: largest remainders get the spare cents."""
    whole = sum(weights)
    if not weights or whole <= 0:
        raise ValueError("weights must sum to a positive amount")
    parts = [amount * w // whole for w in weights]
    spare = sorted(range(len(weights)), key=lambda i: (-(amount * weights[i] % whole), -weights[i], i))
    for i in spare[: amount - sum(parts)]:
        parts[i] += 1
    return parts
