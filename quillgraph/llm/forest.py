"""A random forest for small labelled samples: fitted with array operations, applied as plain arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Nodes of all trees; a leaf is its own child. ``roots``: the first node of each tree."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of label 1 in the leaves that each row of ``x`` reaches."""
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total / len(self.roots)


def _best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """(impurity, feature, threshold) of the split with the least Gini impurity."""
    best = None
    n = len(y)
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        cuts = cuts[(cuts >= least) & (n - cuts >= least)]
        if not len(cuts):
            continue
        a, b = ones[cuts - 1], ones[-1] - ones[cuts - 1]
        gini = a * (1 - a / cuts) + b * (1 - b / (n - cuts))
        k = int(gini.argmin())
        if best is None or gini[k] < best[0]:
            best = (float(gini[k]), int(f), float((v[cuts[k]] + v[cuts[k] - 1]) / 2))
    return best


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    tried = max(1, round(x.shape[1] ** 0.5))
    roots, nodes = [], []

    def grow(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        mine = y[rows]
        nodes.append([0, np.inf, at, at, float(mine.mean())])
        if level < depth and 0 < mine.sum() < len(mine):
            split = _best_split(x[rows], mine, rng.choice(x.shape[1], tried, replace=False), least)
            if split:
                below = x[rows, split[1]] <= split[2]
                nodes[at][:2] = split[1:]
                nodes[at][2] = grow(rows[below], level + 1)
                nodes[at][3] = grow(rows[~below], level + 1)
        return at

    for _ in range(trees):
        roots.append(grow(rng.integers(0, len(y), len(y)), 0))
    f, t, a, b, v = map(np.array, zip(*nodes))
    return Forest(np.array(roots), f.astype(np.int64), t, a.astype(np.int64), b.astype(np.int64), v, depth)
