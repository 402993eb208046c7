"""Small decision-tree ensembles, trained on a bounded sample and flattened into numpy node arrays.

Both ensembles grow their trees on binned features with gradient and curvature sums, so a boosted tree and a
tree of a forest are built by the same code.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees in flat arrays; a leaf is its own child.  Row values go left if <= threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def sums(self, x: np.ndarray) -> np.ndarray:
        """base plus the sum of the leaves' values for each row of ``x``."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total


class _Grower:
    """Grows trees into flat lists."""

    def __init__(self, x: np.ndarray, depth: int, least: int, ridge: float, signs: Sequence[int]) -> None:
        # bounds of the bins are values that occur, so that a threshold splits rows as its bin does
        self.bounds = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        self.binned = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(self.bounds, x.T, strict=True)], axis=1)
        self.depth, self.least, self.ridge, self.signs = depth, least, ridge, signs
        self.nodes: list[list] = []  # feature, threshold, left, right, value
        self.roots: list[int] = []

    def _leaf(self, g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + self.ridge), low, high))

    def _split(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, features: Sequence[int], low: float, high: float):
        best = (1e-9, -1, -1)
        all_g, all_h = g[rows].sum(), h[rows].sum()
        for f in features:
            width = len(self.bounds[f]) + 1
            bins = self.binned[rows, f]
            lg, lh = (np.cumsum(np.bincount(bins, v[rows], width))[:-1] for v in (g, h))
            n = np.cumsum(np.bincount(bins, minlength=width))[:-1]
            rg, rh = all_g - lg, all_h - lh
            left, right = -lg / (lh + self.ridge), -rg / (rh + self.ridge)
            gain = lg**2 / (lh + self.ridge) + rg**2 / (rh + self.ridge) - all_g**2 / (all_h + self.ridge)
            allowed = (n >= self.least) & (len(rows) - n >= self.least)
            if self.signs[f]:
                allowed &= self.signs[f] * (np.clip(right, low, high) - np.clip(left, low, high)) >= 0
            if allowed.any():
                k = int(np.argmax(np.where(allowed, gain, -np.inf)))
                best = max(best, (float(gain[k]), f, k))
        return best[1:]

    def grow(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, pick, scale: float) -> None:
        def node(rows: np.ndarray, level: int, low: float, high: float) -> int:
            at, value = len(self.nodes), self._leaf(g[rows].sum(), h[rows].sum(), low, high)
            self.nodes.append([0, np.inf, at, at, scale * value])
            f, k = self._split(rows, g, h, pick(), low, high) if level < self.depth and len(rows) >= 2 * self.least else (-1, -1)
            if f >= 0:
                goes = self.binned[rows, f] <= k
                a, b = rows[goes], rows[~goes]
                ends = (low, high, low, high)
                if self.signs[f]:  # no leaf below may cross the middle between the two sides
                    middle = (self._leaf(g[a].sum(), h[a].sum(), low, high) + self._leaf(g[b].sum(), h[b].sum(), low, high)) / 2
                    ends = (low, middle, middle, high) if self.signs[f] > 0 else (middle, high, low, middle)
                self.nodes[at][:2] = [f, float(self.bounds[f][k])]
                self.nodes[at][2] = node(a, level + 1, *ends[:2])
                self.nodes[at][3] = node(b, level + 1, *ends[2:])
            return at

        self.roots.append(node(rows, 0, -np.inf, np.inf))

    def flat(self, base: float) -> Trees:
        f, t, a, b, v = (np.array(c) for c in zip(*self.nodes, strict=True))
        return Trees(f.astype(np.int64), t.astype(float), a.astype(np.int64), b.astype(np.int64), v.astype(float), np.array(self.roots), self.depth, base)


def boosted(
    x: np.ndarray, y: np.ndarray, signs: Sequence[int], trees: int = 60, depth: int = 3, rate: float = 0.2, least: int = 20
) -> Trees:
    """Gradient boosting for the logistic loss; ``sums`` gives log-odds.

    ``signs`` has one number for each feature: 1 if the score may only rise with it, -1 if it may only
    fall, 0 if anything goes.
    """
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    grower, score, everything = _Grower(x, depth, least, 1.0, signs), np.full(len(y), base), np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        start = len(grower.nodes)
        grower.grow(everything, p - y, p * (1 - p), lambda: range(x.shape[1]), rate)
        one = grower.flat(0.0)
        score += Trees(one.feature, one.threshold, one.left, one.right, one.value, np.array([start]), depth, 0.0).sums(x)
    return grower.flat(base)


def forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, least: int = 3, seed: int = 1) -> Trees:
    """Random forest on bootstrap samples with random features at each split; ``sums`` gives the mean vote."""
    random, width = np.random.default_rng(seed), x.shape[1]
    grower = _Grower(x, depth, least, 1e-9, [0] * width)
    few = max(1, round(width**0.5))
    for _ in range(trees):
        rows = np.sort(random.integers(0, len(y), len(y)))
        # squared loss: a leaf is the mean of its rows
        grower.grow(rows, -y.astype(float), np.ones(len(y)), lambda: random.choice(width, few, replace=False), 1 / trees)
    return grower.flat(0.0)
