"""Small gradient-boosted trees (logistic loss), fitted on the driver.

Fitting is for bounded samples; a fitted model scores numpy rows or becomes a
DataFrame expression, so that scoring a corpus needs no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1  # below 0: a leaf
    below: float = 0.0  # left if the feature is at most this
    left: Node | None = None
    right: Node | None = None

    def predict(self, x: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
        if self.feature < 0:
            out[rows] += self.value
            return
        left = x[rows, self.feature] <= self.below
        self.left.predict(x, out, rows[left])
        self.right.predict(x, out, rows[~left])


@dataclass
class Boosted:
    start: float = 0.0
    trees: list[Node] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in self.trees:
            t.predict(x, out, rows)
        return out

    def expression(self, feature: Callable[[int], object], when: Callable, lit: Callable) -> object:
        """The logit over columns: feature(i) is a column, when and lit are Spark's."""

        def walk(n: Node):
            if n.feature < 0:
                return lit(float(n.value))
            return when(feature(n.feature) <= lit(float(n.below)), walk(n.left)).otherwise(walk(n.right))

        total = lit(float(self.start))
        for t in self.trees:
            total = total + walk(t)
        return total


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, min_leaf: int = 5, ridge: float = 1.0, bins: int = 32) -> Boosted:
    """x: rows by features; y: 0 or 1. Deterministic."""
    x = np.asarray(x, dtype=np.float64)
    y = np.asarray(y, dtype=np.float64)
    mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(mean / (1 - mean))))
    cuts = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        v = (v[1:] + v[:-1]) / 2
        cuts.append(v if len(v) <= bins else np.unique(np.quantile(v, np.linspace(0, 1, bins))))
    coded = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if len(cuts) else np.zeros((len(x), 0), int)
    z = model.logit(x)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> Node:
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        leaf = Node(value=float(-rate * sum_g / (sum_h + ridge)))
        if not left or len(rows) < 2 * min_leaf:
            return leaf
        best = (1e-6, -1, 0)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            code = coded[rows, j]
            n = np.cumsum(np.bincount(code, minlength=len(c) + 1))[:-1]
            gl = np.cumsum(np.bincount(code, weights=g[rows], minlength=len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(code, weights=h[rows], minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + ridge) + (sum_g - gl) ** 2 / (sum_h - hl + ridge) - sum_g**2 / (sum_h + ridge)
            gain[(n < min_leaf) | (len(rows) - n < min_leaf)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        if best[1] < 0:
            return leaf
        to_left = coded[rows, best[1]] <= best[2]
        return Node(feature=best[1], below=float(cuts[best[1]][best[2]]), left=grow(rows[to_left], g, h, left - 1), right=grow(rows[~to_left], g, h, left - 1))

    for _ in range(rounds):
        p = sigmoid(z)
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), depth)
        model.trees.append(tree)
        tree.predict(x, z, np.arange(len(y)))
    return model


def threshold(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which on held-out rows reach the precision."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    ok = (hits / np.arange(1, len(s) + 1) >= precision) & np.r_[s[1:] != s[:-1], True]
    return float(s[np.flatnonzero(ok)[-1]]) if ok.any() else 1.0
