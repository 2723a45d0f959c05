"""Small gradient-boosted trees for binary decisions, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Logistic boosting of trees of fixed depth over at most 32 bins a feature."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.3
    least: float = 4.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(n, self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-f))
            g, h = prob - y, prob * (1 - prob) + 1e-6
            size = 2**self.depth - 1
            feature, at = np.full(size, -1), np.zeros(size)
            node = np.zeros(n, np.int64)
            for k in range(size):
                rows = np.flatnonzero(node == k)
                if len(rows) == 0:
                    continue
                gain, gs, hs = 1e-6, g[rows].sum(), h[rows].sum()
                for j in range(d):
                    if not len(cuts[j]):
                        continue
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, g[rows], len(cuts[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(cuts[j]) + 1))[:-1]
                    v = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    v[(hl < self.least / 10) | (hs - hl < self.least / 10)] = 0
                    m = int(v.argmax())
                    if v[m] > gain:
                        gain, feature[k], at[k] = float(v[m]), j, cuts[j][m]
                left = np.ones(len(rows), bool) if feature[k] < 0 else x[rows, feature[k]] <= at[k]
                node[rows] = np.where(left, 2 * k + 1, 2 * k + 2)
            leaf = node - size
            gs, hs = np.bincount(leaf, g, size + 1), np.bincount(leaf, h, size + 1)
            value = -self.rate * gs / (hs + 1)
            f += value[leaf]
            self.trees.append((feature, at, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, at, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = feature[node]
                left = (j < 0) | (x[rows, np.maximum(j, 0)] <= at[node])
                node = np.where(left, 2 * node + 1, 2 * node + 2)
            f += value[node - len(feature)]
        return 1 / (1 + np.exp(-f))
