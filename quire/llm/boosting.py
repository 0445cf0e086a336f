"""Gradient-boosted trees for two classes, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: of each inner node a feature and the value up to which rows go left; of each leaf a value."""

    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    depth: int
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, decay: float = 1.0, least: float = 5.0) -> Trees:
    """Second-order boosting of the logistic loss. Cuts lie between quantiles; ties between splits go to the first."""
    n, p = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(p)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    inner, leaves = 2**depth - 1, 2**depth
    features, cuts, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    f = np.full(n, start)
    for t in range(trees):
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, np.maximum(q * (1 - q), 1e-9)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            key = (at - first) * bins
            total_g, total_h = np.bincount(at - first, g, wide), np.bincount(at - first, h, wide)
            best, chosen, cut = np.full(wide, 1e-9), np.zeros(wide, np.int64), np.full(wide, np.inf)
            for j in range(p):
                if not len(edges[j]):
                    continue
                left_g = np.bincount(key + binned[:, j], g, wide * bins).reshape(wide, bins).cumsum(1)[:, : len(edges[j])]
                left_h = np.bincount(key + binned[:, j], h, wide * bins).reshape(wide, bins).cumsum(1)[:, : len(edges[j])]
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + decay) + right_g**2 / (right_h + decay) - (total_g**2 / (total_h + decay))[:, None]
                gain[(np.minimum(left_h, right_h) < least * 0.05)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(wide), k]
                better = top > best
                best[better], chosen[better], cut[better] = top[better], j, edges[j][k[better]]
            features[t, first : first + wide], cuts[t, first : first + wide] = chosen, cut
            at = 2 * at + 1 + (x[np.arange(n), features[t, at]] > cuts[t, at])
        leaf = at - inner
        values[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + decay)
        f += values[t][leaf]
    return Trees(features, cuts, values, depth, start)
