"""Gradient-boosted trees for a yes or no, over binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Complete trees of one depth; node k's children are 2k+1 and 2k+2."""

    def __init__(self, depth: int = 4, trees: int = 30, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> None:
        self.depth, self.n_trees, self.rate, self.bins, self.ridge = depth, trees, rate, bins, ridge
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            prob = 1 / (1 + np.exp(-score))
            score += self._grow(binned, edges, y - prob, prob * (1 - prob), score)
        return self

    def _grow(self, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, score: np.ndarray) -> np.ndarray:
        inner = (1 << self.depth) - 1
        feature, limit, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        node = np.zeros(len(g), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = (1e-6, 0, -1)
            if len(rows) >= 2:
                gs, hs = g[rows].sum(), h[rows].sum()
                whole = gs * gs / (hs + self.ridge)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                    gain = gl * gl / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - whole
                    c = int(np.argmax(gain))
                    if gain[c] > best[0]:
                        best = (float(gain[c]), j, c)
            if best[2] >= 0:
                feature[k], limit[k] = best[1], edges[best[1]][best[2]]
                node[rows] = 2 * k + 1 + (binned[rows, best[1]] > best[2])
            else:
                node[rows] = 2 * k + 1
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = self.rate * gs / (hs + self.ridge)
        self.trees.append((feature, limit, value))
        return value[leaf]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), (1 << self.depth) - 1
        for feature, limit, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - inner]
        return out
