"""Histogram gradient-boosted trees in numpy: complete binary trees kept as flat arrays and walked level by level."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """``feature`` and ``cut`` are trees x inner nodes, ``leaf`` trees x leaves; a row goes right where its value > cut."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = int(self.leaf.shape[1]).bit_length() - 1 if len(self.leaf) else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 2.0, least: float = 3.0) -> Forest:
    """Second-order boosting of the logistic loss; ``least`` is the least sum of hessians in a child.

    Without rows the forest answers 0.5; with one class, close to that class."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(mean / (1 - mean)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not len(y) or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    n, width = x.shape
    edges, codes = [], np.zeros((n, width), np.int64)
    for f in range(width):
        edge = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        edges.append(edge)
        codes[:, f] = np.searchsorted(edge, x[:, f], "left")  # code <= c  <=>  value <= edge[c]
    margin, out = np.full(n, start), []
    slots = np.arange(width) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            base, count = (1 << level) - 1, 1 << level
            at = ((node - base)[:, None] * (width * bins) + slots[None, :] + codes).ravel()
            size = count * width * bins
            hist_g = np.bincount(at, np.repeat(g, width), size).reshape(count, width, bins).cumsum(2)
            hist_h = np.bincount(at, np.repeat(h, width), size).reshape(count, width, bins).cumsum(2)
            all_g, all_h = hist_g[:, :1, -1:], hist_h[:, :1, -1:]
            right_g, right_h = all_g - hist_g, all_h - hist_h
            gain = hist_g**2 / (hist_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(hist_h < least) | (right_h < least)] = -1
            flat = gain.reshape(count, -1)
            best = flat.argmax(1)
            for k in range(count):
                f, c = divmod(int(best[k]), bins)
                if flat[k, best[k]] > 1e-3 and c < len(edges[f]):
                    feature[base + k], cut[base + k] = f, edges[f][c]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += value[leaf]
        out.append((feature, cut, value))
    return Forest(np.stack([o[0] for o in out]), np.stack([o[1] for o in out]), np.stack([o[2] for o in out]), start)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing map from score to probability, for ``np.interp``."""
    if not len(y):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of scores
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    knots = np.array([b[2] / b[1] for b in blocks])
    values = np.array([(b[0] + 0.05) / (b[1] + 0.1) for b in blocks])
    return knots, np.maximum.accumulate(values)
