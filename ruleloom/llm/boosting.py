"""Gradient-boosted trees on binned dense features, and isotonic calibration, in numpy.

Used on a bounded sample of labelled rows; the fitted model is a few thousand numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 48


@dataclass
class Boosted:
    """Logistic boosting of depth-limited trees; a tree is arrays (feature, cut, value) in heap order."""

    edges: list[np.ndarray]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    depth: int = 3

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > cut[node])
                node = 2 * node + 1 + right
            out += value[node - (2**self.depth - 1)]
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, least: int = 4) -> Boosted:
    p = (y.sum() + 0.5) / (len(y) + 1.0)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T]
    model = Boosted(edges, float(np.log(p / (1 - p))), depth=depth)
    if len(y) < 2 * least or y.min() == y.max():
        return model
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    width, n_features = BINS + 1, x.shape[1]
    flat = binned + np.arange(n_features) * width
    score = np.full(len(y), model.base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        grad, hess = q - y, np.maximum(q * (1 - q), 1e-9)
        feature, cut = np.full(2**depth - 1, -1), np.zeros(2**depth - 1)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                right = np.zeros(len(rows), bool)
                if len(rows) >= 2 * least:
                    cells = flat[rows].ravel()
                    sums = [np.bincount(cells, np.repeat(v[rows], n_features), n_features * width).reshape(n_features, width).cumsum(axis=1) for v in (grad, hess, np.ones(len(y)))]
                    g, h, n = sums
                    gt, ht, nt = g[:, -1:], h[:, -1:], n[:, -1:]
                    gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                    gain[(n < least) | (nt - n < least)] = -1
                    f, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[f, b] > 1e-6 and b < len(edges[f]):
                        feature[k], cut[k] = f, edges[f][b]
                        right = binned[rows, f] > b
                node[rows] = 2 * k + 1 + right
        leaf = node - (2**depth - 1)
        g, h = np.bincount(leaf, grad, 2**depth), np.bincount(leaf, hess, 2**depth)
        value = -rate * g / (h + ridge)
        model.trees.append((feature, cut, value))
        score += value[leaf]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots ``(score, probability)``, both rising."""
    at, inverse = np.unique(score, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    blocks: list[list[float]] = []  # low, high, weight, sum
    for s, w, t in zip(at, weight, np.bincount(inverse, y)):
        blocks.append([s, s, w, t])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    xs, ps = [], []
    for low, high, w, t in blocks:
        for s in {low, high}:
            xs.append(s)
            ps.append((t + 0.05) / (w + 0.1))
    order = np.lexsort((ps, xs))
    return np.array(xs)[order], np.maximum.accumulate(np.array(ps)[order])
