"""Histogram gradient-boosted trees for a binary label, flattened into arrays for numpy traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees in one set of arrays; a node's children are indexes, a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.bias)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                low = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        return values
    return values[:-1]


def fit(
    x: np.ndarray,
    y: np.ndarray,
    *,
    rounds: int = 80,
    depth: int = 4,
    rate: float = 0.12,
    bins: int = 64,
    min_rows: int = 10,
    ridge: float = 2.0,
) -> Trees:
    """Boost ``rounds`` trees on the logistic loss; gradients are summed per bin, node and feature."""
    n, n_features = x.shape
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, j], bins) for j in range(n_features)]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, n_features), int)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        at = len(feature)
        feature.append(0), threshold.append(0.0), left.append(at), right.append(at), value.append(0.0)
        return at

    margin = np.full(n, bias)
    for _ in range(rounds if n and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        live = [(root, np.arange(n), 0)]
        while live:
            at, rows, level = live.pop()
            sum_g, sum_h = g[rows].sum(), h[rows].sum()
            value[at] = float(-rate * sum_g / (sum_h + ridge))
            best = None
            if level < depth and len(rows) >= 2 * min_rows:
                score = sum_g**2 / (sum_h + ridge)
                for j in range(n_features):
                    size = len(edges[j]) + 1
                    if size < 2:
                        continue
                    c = codes[rows, j]
                    low_n = np.bincount(c, minlength=size).cumsum()[:-1]
                    low_g = np.bincount(c, g[rows], size).cumsum()[:-1]
                    low_h = np.bincount(c, h[rows], size).cumsum()[:-1]
                    gain = low_g**2 / (low_h + ridge) + (sum_g - low_g) ** 2 / (sum_h - low_h + ridge) - score
                    gain[(low_n < min_rows) | (len(rows) - low_n < min_rows)] = -np.inf
                    k = int(gain.argmax())
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = (gain[k], j, k)
            if best is None:
                margin[rows] += value[at]
                continue
            _, j, k = best
            feature[at], threshold[at] = j, float(edges[j][k])
            left[at], right[at] = node(), node()
            low = codes[rows, j] <= k
            live += [(left[at], rows[low], level + 1), (right[at], rows[~low], level + 1)]
    return Trees(
        np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(right, np.int32),
        np.array(value), np.array(roots, np.int32), depth, bias,
    )
