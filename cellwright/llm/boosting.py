"""Gradient-boosted trees for yes or no: logistic loss, binned features, oblivious-depth trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature, threshold (nodes, heap order), leaf values
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0) -> Boosted:
    """Second-order boosting; each node's split is the best of all features and bin edges."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # x <= edge: code <= its index
    share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), [], depth)
    score = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            local = at - first
            best = np.full(n, 1e-9)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = local * (len(e) + 1) + code[:, j]
                gs = np.bincount(cell, g, n * (len(e) + 1)).reshape(n, -1).cumsum(axis=1)
                hs = np.bincount(cell, h, n * (len(e) + 1)).reshape(n, -1).cumsum(axis=1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain = np.where((hl >= least / 100) & (ht - hl >= least / 100), gain, 0)
                k = gain.argmax(axis=1)
                top = gain[np.arange(n), k]
                better = top > best
                best[better] = top[better]
                feature[first : first + n][better] = j
                threshold[first : first + n][better] = e[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf_of = at - inner
        gs, hs = np.bincount(leaf_of, g, inner + 1), np.bincount(leaf_of, h, inner + 1)
        leaf = rate * gs / (hs + ridge)
        model.trees.append((feature, threshold, leaf))
        score += leaf[leaf_of]
    return model
