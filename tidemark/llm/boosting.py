"""Histogram gradient-boosted trees for a yes-or-no label, in NumPy, flattened into arrays."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of a fixed depth as arrays (tree, node); the children of node i are 2i+1 and 2i+2, values stand in the last level."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 2.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.smooth, self.least = trees, depth, rate, bins, smooth, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        inner, leaves = 2**self.depth - 1, 2**self.depth
        share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.feature = np.zeros((self.trees, inner), np.int32)
        self.threshold = np.full((self.trees, inner), np.inf, np.float32)  # everything goes left unless a split was found
        self.value = np.zeros((self.trees, leaves), np.float32)
        if not n or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1]).astype(np.float32)) for j in range(width)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(width)], 1)
        flat = binned + np.arange(width) * self.bins
        score = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                base, count = 2**level - 1, 2**level
                at = (flat + (node - base)[:, None] * (width * self.bins)).ravel()
                shape = (count, width, self.bins)
                g = np.bincount(at, np.repeat(grad, width), count * width * self.bins).reshape(shape).cumsum(2)
                h = np.bincount(at, np.repeat(hess, width), count * width * self.bins).reshape(shape).cumsum(2)
                g_all, h_all = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + self.smooth) + (g_all - g) ** 2 / (h_all - h + self.smooth) - g_all**2 / (h_all + self.smooth)
                gain[(h < self.least) | (h_all - h < self.least)] = 0
                for j in range(width):
                    gain[:, j, len(cuts[j]) :] = 0
                best = gain.reshape(count, -1).argmax(1)
                found = gain.reshape(count, -1).max(1) > 1e-6
                j, b = best // self.bins, best % self.bins
                self.feature[t, base : base + count] = j
                for i in np.flatnonzero(found):
                    self.threshold[t, base + i] = cuts[j[i]][b[i]]
                own = node - base
                right = found[own] & (binned[np.arange(n), j[own]] > b[own])
                node = 2 * node + 1 + right
            leaf = node - inner
            g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
            self.value[t] = self.rate * g / (h + self.smooth)
            score += self.value[t][leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; every tree is one walk of all rows at once."""
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            score += value[node - len(feature)]
        return 1 / (1 + np.exp(-score))
