"""Histogram gradient-boosted trees for two classes, kept as flat arrays that whole batches walk through together.

Training happens on a bounded sample in the driver; the trees are a few kilobytes and travel with the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: node k has children 2k+1 and 2k+2; a row goes right where its feature exceeds the cut."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            out += leaf[node - len(cut)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Logistic loss, second-order gains over per-node histograms. One class only, or no rows: a constant score."""
    inner, leaves = 2**depth - 1, 2**depth
    p = (float(np.sum(y)) + 0.5) / (len(y) + 1)
    base = float(np.log(p / (1 - p)))
    n_features = x.shape[1] if x.ndim == 2 else 1
    if not len(y) or np.all(y == y[0]):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    margin = np.full(len(y), base)
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, prob * (1 - prob)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            at = node - first
            best, pick_f, pick_b = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, -1)
            for j in range(n_features):
                place = at * bins + binned[j]
                g = np.cumsum(np.bincount(place, grad, width * bins).reshape(width, bins), 1)
                h = np.cumsum(np.bincount(place, hess, width * bins).reshape(width, bins), 1)
                ga, ha = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (ga - g) ** 2 / (ha - h + ridge) - ga**2 / (ha + ridge)
                gain[(h < 1e-3) | (ha - h < 1e-3)] = 0
                gain[:, len(edges[j]) :] = 0
                k = np.argmax(gain, 1)
                better = gain[np.arange(width), k] > best
                best = np.where(better, gain[np.arange(width), k], best)
                pick_f, pick_b = np.where(better, j, pick_f), np.where(better, k, pick_b)
            for k in np.flatnonzero(pick_b >= 0):
                feature[first + k], cut[first + k] = pick_f[k], edges[pick_f[k]][pick_b[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        leaf = -rate * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + ridge)
        margin += leaf[at]
        made.append((feature, cut, leaf))
    return Trees(*(np.stack(part) for part in zip(*made, strict=True)), base)
