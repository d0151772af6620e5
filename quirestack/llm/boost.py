"""Gradient-boosted trees on the logistic loss, on histograms of the features."""

from __future__ import annotations

import numpy as np


class Boost:
    """Fit on a bounded sample on the driver; small enough to travel with a task."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 5.0) -> None:
        x = np.asarray(x, float)
        y = np.asarray(y, float)
        self.depth, self.rate = depth, rate
        # cuts at quantiles of the rows and of the distinct values, so that rare large values keep bins of their own, and at
        # even distances, so that a gap between the classes is not left without one
        at, even = np.linspace(0, 1, bins // 3 + 2)[1:-1], np.linspace(0, 1, bins // 3 + 1)[1:-1]
        self.edges = [np.unique(np.r_[np.quantile(c, at), np.quantile(np.unique(c), at), c.min() + even * np.ptp(c)]) if len(c) else np.zeros(0) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1) if len(x) else np.zeros((0, x.shape[1]), int)
        mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(trees if len(np.unique(y)) > 1 else 0):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(codes, p - y, np.maximum(p * (1 - p), 1e-6), bins, least)
            self.trees.append(tree)
            score += rate * self._walk(tree, codes)

    def _grow(self, codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, bins: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A full tree as arrays of features, cut codes and leaf values; a node that does not split sends all left."""
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, bins + 1, np.int64)
        node = np.zeros(len(grad), np.int64)
        for level in range(self.depth):
            first, count = (1 << level) - 1, 1 << level
            local = node - first
            best = np.full(count, 1e-9)
            for f in range(codes.shape[1]):
                key = local * (bins + 1) + codes[:, f]
                g = np.bincount(key, grad, count * (bins + 1)).reshape(count, -1).cumsum(1)
                h = np.bincount(key, hess, count * (bins + 1)).reshape(count, -1).cumsum(1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                gain[(h < least * 0.05) | (ht - h < least * 0.05)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                # cuts that part the rows alike differ only in where new rows fall: the middle one keeps away from both sides
                apart = gain < top[:, None] - 1e-9 * np.abs(top[:, None])
                apart[np.arange(gain.shape[1])[None, :] < at[:, None]] = False
                at = (at + np.where(apart.any(1), apart.argmax(1), gain.shape[1]) - 1) // 2
                win = top > best
                best[win] = top[win]
                feature[first : first + count][win] = f
                cut[first : first + count][win] = at[win]
            node = 2 * node + 1 + (codes[np.arange(len(node)), feature[node]] > cut[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        return feature, cut, -g / (h + 1)

    def _walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(codes), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (codes[np.arange(len(node)), feature[node]] > cut[node])
        return value[node - len(feature)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        x = np.asarray(x, float)
        codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1) if len(x) else np.zeros((0, len(self.edges)), int)
        score = np.full(len(codes), self.base)
        for tree in self.trees:
            score += self.rate * self._walk(tree, codes)
        return 1 / (1 + np.exp(-score))
