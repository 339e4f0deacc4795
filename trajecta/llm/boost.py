"""Gradient-boosted trees for two classes, in numpy: binned features, trees of a fixed depth, log loss."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Each tree is (feature, bin) for every inner node of a full tree and a value for every leaf."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, ridge: float = 2.0):
        self.trees, self.depth, self.rate, self.ridge = trees, depth, rate, ridge
        self.base, self.features, self.cuts, self.leaves = 0.0, np.empty((0, 0), np.int64), np.empty((0, 0)), np.empty((0, 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        n, f = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        inner, outer = (1 << self.depth) - 1, 1 << self.depth
        self.features, self.cuts, self.leaves = np.zeros((self.trees, inner), np.int64), np.full((self.trees, inner), np.inf), np.zeros((self.trees, outer))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                width, first = 1 << level, (1 << level) - 1
                best, where = np.zeros(width), np.full((width, 2), -1)
                for j in range(f):
                    if not len(edges[j]):
                        continue
                    key = node * BINS + binned[:, j]
                    sg, sh = (np.bincount(key, v, width * BINS).reshape(width, BINS) for v in (g, h))
                    lg, lh = np.cumsum(sg, axis=1)[:, :-1], np.cumsum(sh, axis=1)[:, :-1]
                    tg, th = sg.sum(axis=1, keepdims=True), sh.sum(axis=1, keepdims=True)
                    gain = lg**2 / (lh + self.ridge) + (tg - lg) ** 2 / (th - lh + self.ridge) - tg**2 / (th + self.ridge)
                    gain[(lh < 1) | (th - lh < 1)] = 0
                    at = gain[:, : len(edges[j])].argmax(axis=1)
                    top = gain[np.arange(width), at]
                    better = top > best + 1e-9
                    best[better], where[better] = top[better], np.stack([np.full(width, j), at], axis=1)[better]
                right = np.zeros(n, bool)
                for k in range(width):
                    j, at = where[k]
                    if j >= 0:
                        self.features[t, first + k], self.cuts[t, first + k] = j, edges[j][at]
                        own = node == k
                        right[own] = binned[own, j] > at
                node = 2 * node + right
            sg, sh = (np.bincount(node, v, outer) for v in (g, h))
            self.leaves[t] = -self.rate * sg / (sh + self.ridge)
            score += self.leaves[t][node]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.leaves)):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                k = node + ((1 << level) - 1)
                node = 2 * node + (x[rows, self.features[t, k]] > self.cuts[t, k])
            out += self.leaves[t, node]
        return out
