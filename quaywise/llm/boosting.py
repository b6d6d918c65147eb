"""Gradient-boosted regression trees for a two-class target, on small in-memory samples.

Trees are grown on quantile bins with Newton leaf values, stored as flat arrays and applied to many rows at
once. Fitting is for bounded training samples; applying is pure array work inside Spark tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # [tree, node]
    cut: np.ndarray  # [tree, node]: go right where the feature is over it
    value: np.ndarray  # [tree, leaf]
    base: float
    depth: int

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: int = 20) -> Trees:
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    now = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-now))
        grad, hess = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.zeros(width)
            for j in range(d):
                b = len(edges[j]) + 1
                if b < 2:
                    continue
                key = local * b + code[:, j]
                g, h, c = (np.bincount(key, w, width * b).reshape(width, b).cumsum(1) for w in (grad, hess, None))
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain[(c < least) | (ct - c < least)] = 0
                k = gain[:, :-1].argmax(1)
                top = gain[np.arange(width), k]
                for w in np.flatnonzero(top > best + 1e-9):
                    best[w], feature[first + w], cut[first + w] = top[w], j, edges[j][k[w]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        value = rate * g / (h + ridge)
        now = now + value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(np.array(features), np.array(cuts), np.array(values), base, depth)
