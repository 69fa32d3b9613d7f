"""A small gradient-boosted tree classifier for bounded candidate tables."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Log-loss boosting of depth-limited trees over features cut into quantile bins; the same rows give the same trees."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.base, self.trees, self.edges = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.base)
        for _ in range(self.n):
            prob = 1 / (1 + np.exp(-z))
            tree = self._grow(code, prob - y, prob * (1 - prob), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            z += self._walk(tree, code)
        return self

    def _grow(self, code, g, h, rows, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = -self.rate * total_g / (total_h + self.ridge)
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        best = (1e-6, None, None)
        for j in range(code.shape[1]):
            c = code[rows, j]
            n = len(self.edges[j]) + 1
            left_g, left_h = np.cumsum(np.bincount(c, g[rows], n))[:-1], np.cumsum(np.bincount(c, h[rows], n))[:-1]
            count = np.cumsum(np.bincount(c, minlength=n))[:-1]
            gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge) - total_g**2 / (total_h + self.ridge)
            gain = np.where((count >= self.least) & (len(rows) - count >= self.least), gain, 0)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), j, int(gain.argmax()))
        if best[1] is None:
            return leaf
        goes = code[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(code, g, h, rows[goes], depth - 1), self._grow(code, g, h, rows[~goes], depth - 1)

    def _walk(self, tree, code):
        if not isinstance(tree, tuple):
            return np.full(len(code), tree)
        out, goes = np.empty(len(code)), code[:, tree[0]] <= tree[1]
        out[goes], out[~goes] = self._walk(tree[2], code[goes]), self._walk(tree[3], code[~goes])
        return out

    def decision(self, x: np.ndarray) -> np.ndarray:
        code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)
        return self.base + sum((self._walk(t, code) for t in self.trees), np.zeros(len(x)))


def calibrated_threshold(z: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score above which at least the given share of held-back candidates is right, counted with one wrong one more."""
    order = np.argsort(-z, kind="stable")
    right = np.cumsum(y[order])
    ok = np.flatnonzero(right / (np.arange(len(z)) + 2) >= precision)
    return float(z[order[ok[-1]]]) if len(ok) else float("inf")
