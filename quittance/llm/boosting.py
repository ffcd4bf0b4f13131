"""Gradient-boosted trees for logistic loss on binned features, in NumPy.

Trees are grown level by level from histograms of gradients and second derivatives
and stored as arrays, so all rows of a batch walk a tree together.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """cuts[f]: bin edges of feature f; trees: (feature, threshold bin, leaf values) of full binary trees."""

    cuts: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    base: float
    depth: int

    def dumped(self) -> str:
        """The model as JSON, a tree a line."""
        trees = ",\n".join(json.dumps([part.tolist() for part in t]) for t in self.trees)
        return f'{{"base": {self.base!r}, "depth": {self.depth},\n"cuts": {json.dumps([c.tolist() for c in self.cuts])},\n"trees": [\n{trees}]}}\n'

    @classmethod
    def loaded(cls, text: str) -> Boosted:
        d = json.loads(text)
        trees = [(np.array(f, np.int64), np.array(c, np.int64), np.array(v)) for f, c, v in d["trees"]]
        return cls([np.array(c) for c in d["cuts"]], trees, d["base"], d["depth"])

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)]).astype(np.uint8) if len(x) else np.zeros((0, len(self.cuts)), np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1."""
        b = self.bins(x)
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[row, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 90, depth: int = 5, rate: float = 0.25, bins: int = 32, l2: float = 1.0, least: float = 2.0) -> Boosted:
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Boosted(cuts, [], float(np.log(p / (1 - p))), depth)
    b = model.bins(x)
    n, width = b.shape
    score = np.full(n, model.base)
    offsets = np.arange(width) * bins
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-score))
        g, h = y - prob, np.maximum(prob * (1 - prob), 1e-6)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 255, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (width * bins) + offsets + b).ravel()
            size = count * width * bins
            hist = [np.bincount(key, np.repeat(v, width), size).reshape(count, width, bins).cumsum(2) for v in (g, h)]
            total = [v[:, :1, -1:] for v in hist]
            right = [t - v for t, v in zip(total, hist, strict=True)]
            gain = hist[0] ** 2 / (hist[1] + l2) + right[0] ** 2 / (right[1] + l2) - total[0] ** 2 / (total[1] + l2)
            gain[(hist[1] < least) | (right[1] < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            feature[first : first + count] = np.where(good, best // bins, 0)
            cut[first : first + count] = np.where(good, best % bins, 255)
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        model.trees.append((feature, cut, value))
        score += value[leaf]
    return model
