"""Gradient-boosted trees for two classes, in numpy: binned features, trees of one fixed depth."""

from __future__ import annotations

import numpy as np

BINS = 32
DEPTH = 4
RATE = 0.2
PULL = 1.0


class Trees:
    """Complete binary trees as arrays: a feature and a limit per inner node, a value per leaf."""

    def __init__(self, base: float, feature: np.ndarray, limit: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.limit, self.value = base, feature, limit, value

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, count: int) -> Trees:
    """Newton boosting of the logistic loss with histogram splits."""
    limits = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(limits[f], x[:, f], side="left") for f in range(x.shape[1])], 1)
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    features, cuts, values = np.zeros((count, inner), np.int64), np.full((count, inner), np.inf), np.zeros((count, leaves))
    logit = np.full(len(y), base)
    for tree in range(count):
        p = 1 / (1 + np.exp(-logit))
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-6)
            pick = [(0, np.inf, BINS)] * width
            for f in range(x.shape[1]):
                cell = at * BINS + binned[:, f]
                g = np.bincount(cell, slope, width * BINS).reshape(width, BINS).cumsum(1)
                h = np.bincount(cell, curve, width * BINS).reshape(width, BINS).cumsum(1)
                score = lambda a, b: a * a / (b + PULL)
                gain = score(g, h) + score(g[:, -1:] - g, h[:, -1:] - h) - score(g[:, -1:], h[:, -1:])
                cut = gain[:, : len(limits[f])].argmax(1) if len(limits[f]) else None
                for w in range(width) if cut is not None else ():
                    if gain[w, cut[w]] > best[w]:
                        best[w], pick[w] = gain[w, cut[w]], (f, limits[f][cut[w]], cut[w])
            chosen = np.array([p[0] for p in pick])
            bound = np.array([p[2] for p in pick])
            features[tree, first : first + width] = chosen
            cuts[tree, first : first + width] = [p[1] for p in pick]
            node = 2 * node + 1 + (binned[np.arange(len(y)), chosen[at]] > bound[at])
        leaf = node - inner
        values[tree] = RATE * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, curve, leaves) + PULL)
        logit += values[tree][leaf]
    return Trees(base, features, cuts, values)
