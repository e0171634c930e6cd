"""Gradient-boosted trees for small dense feature tables, in NumPy: logistic loss, binned features, shallow trees."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BoostedTrees:
    """Trees of `depth` levels as flat arrays: the children of node k are 2k + 1 (at or below the cut) and 2k + 2."""

    rounds: int = 40
    depth: int = 4
    rate: float = 0.3
    bins: int = 32
    smooth: float = 1.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Fits features `x` (rows, features) to labels `y` of 0 and 1; one class alone gives a constant model."""
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.base, self.trees = float(np.log(share / (1 - share))), []
        if len(np.unique(y)) < 2:
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = _sigmoid(score)
            tree, step = self._tree(codes, cuts, y - p, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            score += step
        return self

    def _tree(self, codes, cuts, gradient, hessian):
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(gradient), dtype=np.int64)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            g, h = gradient[rows], hessian[rows]
            value[node] = self.rate * g.sum() / (h.sum() + self.smooth)
            if node >= 2**self.depth - 1 or len(rows) < 8:
                continue
            gain, best = 1e-3, None
            whole = g.sum() ** 2 / (h.sum() + self.smooth)
            for f in range(codes.shape[1]):
                if not len(cuts[f]):
                    continue
                size = len(cuts[f]) + 1
                left_g = np.cumsum(np.bincount(codes[rows, f], g, size))[:-1]
                left_h = np.cumsum(np.bincount(codes[rows, f], h, size))[:-1]
                gains = left_g**2 / (left_h + self.smooth) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + self.smooth) - whole
                k = int(gains.argmax())
                if gains[k] > gain:
                    gain, best = gains[k], (f, k)
            if best:
                feature[node], cut[node] = best[0], cuts[best[0]][best[1]]
                at[rows] = np.where(codes[rows, best[0]] <= best[1], 2 * node + 1, 2 * node + 2)
        return (feature, cut, value), value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        score = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                below = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(below, 2 * at + 1, 2 * at + 2), at)
            score += value[at]
        return _sigmoid(score)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest range of thresholds with the best F1; 0.5 where there is nothing to choose from."""
    if not len(y) or len(np.unique(y)) < 2:
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    edges = np.append(p[order], 0.0)
    f1[:-1][edges[:-2] == edges[1:-1]] = -1  # equal scores can't be parted
    k = max(np.flatnonzero(f1 >= f1.max() - 1e-12), key=lambda i: edges[i] - edges[i + 1])
    return float((edges[k] + edges[k + 1]) / 2)
