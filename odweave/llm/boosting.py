"""Gradient-boosted regression trees with logistic loss, in NumPy, for small feature tables."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited trees on quantile-binned features; Newton leaf values; deterministic."""

    def __init__(self, n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.l2 = n_trees, depth, rate, bins, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, d = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], 1)
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(p0 / (1 - p0)))
        f = np.full(n, self.bias)
        nodes = 2 ** (self.depth + 1) - 1
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
            at = np.zeros(n, int)
            for node in range(nodes):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                sg, sh = g[rows].sum(), h[rows].sum()
                value[node] = -self.rate * sg / (sh + self.l2)
                if node >= nodes // 2 or len(rows) < 8:
                    continue
                best = (1e-6, -1, 0)
                for j in range(d):
                    if not len(cuts[j]):
                        continue
                    b = binned[rows, j]
                    lg = np.cumsum(np.bincount(b, g[rows], len(cuts[j]) + 1))[:-1]
                    lh = np.cumsum(np.bincount(b, h[rows], len(cuts[j]) + 1))[:-1]
                    gain = lg**2 / (lh + self.l2) + (sg - lg) ** 2 / (sh - lh + self.l2) - sg**2 / (sh + self.l2)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
                if best[1] >= 0:
                    _, j, k = best
                    feature[node], cut[node] = j, cuts[j][k]
                    at[rows] = np.where(binned[rows, j] <= k, 2 * node + 1, 2 * node + 2)
            self.trees.append((feature, cut, value))
            f += value[at]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                j = feature[at]
                go = j >= 0
                step = np.where(x[rows, np.maximum(j, 0)] <= cut[at], 2 * at + 1, 2 * at + 2)
                at = np.where(go, step, at)
            f += value[at]
        return f

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Calibration a*margin + b by Newton steps on held-out rows, with smoothed labels."""
    a, b = 1.0, 0.0
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        w = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        hess = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
