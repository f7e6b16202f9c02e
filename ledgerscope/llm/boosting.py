"""Histogram gradient-boosted trees for two classes, and isotonic calibration.

Fitting takes a bounded sample in memory. Every tree has the same depth and lies in flat
arrays (the children of node i are 2i + 1 and 2i + 2), so all rows walk all trees by array look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class BoostParams:
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.1
    min_rows: int = 8
    l2: float = 1.0


@dataclass(frozen=True)
class Trees:
    start: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # values above go right
    leaf: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = inner.bit_length()
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, params: BoostParams = BoostParams()) -> Trees:
    """Boosted trees for labels 0 and 1. One class only, or no rows, gives a constant."""
    n, width = len(x), max(1, x.shape[1])
    inner, leaves, bins = 2**params.depth - 1, 2**params.depth, params.bins
    share = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    feature = np.zeros((params.trees, inner), np.int64)
    threshold = np.full((params.trees, inner), np.inf)
    leaf = np.zeros((params.trees, leaves))
    if n == 0 or y.min() == y.max():
        return Trees(start, feature[:0], threshold[:0], leaf[:0])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    raw = np.full(n, start)
    for tree in range(params.trees):
        p = sigmoid(raw)
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(params.depth):
            size = 2**level
            best = np.full(size, 1e-6)
            chosen, at = np.zeros(size, np.int64), np.full(size, bins, np.int64)
            for f in range(width):
                cell = node * bins + binned[f]
                g, h, c = (
                    np.bincount(cell, weights=w, minlength=size * bins).reshape(size, bins).cumsum(1)
                    for w in (gradient, weight, None)
                )
                gain = (
                    g**2 / (h + params.l2)
                    + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + params.l2)
                    - g[:, -1:] ** 2 / (h[:, -1:] + params.l2)
                )
                gain[(c < params.min_rows) | (c[:, -1:] - c < params.min_rows)] = 0
                gain[:, len(cuts[f]) :] = 0
                top = gain.argmax(1)
                value = gain[np.arange(size), top]
                better = value > best
                best[better], chosen[better], at[better] = value[better], f, top[better]
            first = size - 1
            for k in range(size):
                feature[tree, first + k] = chosen[k]
                if at[k] < bins:
                    threshold[tree, first + k] = cuts[chosen[k]][at[k]]
            node = 2 * node + (binned[chosen[node], np.arange(n)] > at[node])
        g = np.bincount(node, weights=gradient, minlength=leaves)
        h = np.bincount(node, weights=weight, minlength=leaves)
        leaf[tree] = -params.rate * g / (h + params.l2)
        raw += leaf[tree][node]
    return Trees(start, feature, threshold, leaf)


@dataclass(frozen=True)
class Isotonic:
    """A rising step function, linear between the middles of its steps."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.value) if len(self.at) else score


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; equal scores are one point."""
    levels, place = np.unique(score, return_inverse=True)
    weight = np.bincount(place, minlength=len(levels)).astype(float)
    total = np.bincount(place, weights=y, minlength=len(levels))
    pools: list[list[float]] = []  # value, weight, score x weight
    for s, w, t in zip(levels, weight, total, strict=True):
        pools.append([t / w, w, s * w])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, w1, s1 = pools.pop()
            u, w0, s0 = pools.pop()
            pools.append([(u * w0 + v * w1) / (w0 + w1), w0 + w1, s0 + s1])
    return Isotonic(np.array([p[2] / p[1] for p in pools]), np.array([p[0] for p in pools]))
