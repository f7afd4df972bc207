"""Small boosted trees in numpy, and their translation into Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    """A split (rows with x[feature] <= at go left) or a leaf."""

    value: float
    feature: int = -1
    at: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.at, self.left.predict(x), self.right.predict(x))

    def column(self, features: list[Column]) -> Column:
        if self.left is None:
            return F.lit(float(self.value))
        return F.when(features[self.feature] <= float(self.at), self.left.column(features)).otherwise(self.right.column(features))

    def paths(self, so_far: tuple = ()) -> list[tuple]:
        """Conjunctions (feature, is at most, bound) of every way from the root to an inner node or a leaf."""
        own = [so_far] if so_far else []
        if self.left is None:
            return own
        return own + self.left.paths((*so_far, (self.feature, True, self.at))) + self.right.paths((*so_far, (self.feature, False, self.at)))


def cuts_of(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Candidate bounds a feature: midpoints between its quantiles."""
    out = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, most + 1), method="nearest"))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def _grow(binned, cuts, rows, grad, hess, depth, least, damp) -> Node:
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = Node(float(g / (h + damp)))
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best, split = g * g / (h + damp) + 1e-6, None
    for f, c in enumerate(cuts):
        if len(c):
            b = binned[rows, f]
            gs = np.cumsum(np.bincount(b, grad[rows], len(c) + 1))[:-1]
            hs = np.cumsum(np.bincount(b, hess[rows], len(c) + 1))[:-1]
            n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            gain = gs * gs / (hs + damp) + (g - gs) ** 2 / (h - hs + damp)
            gain[(n < least) | (len(rows) - n < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best:
                best, split = gain[k], (f, k)
    if split is None:
        return leaf
    f, k = split
    go = binned[rows, f] <= k
    deeper = lambda r: _grow(binned, cuts, r, grad, hess, depth - 1, least, damp)
    return Node(leaf.value, f, float(cuts[f][k]), deeper(rows[go]), deeper(rows[~go]))


def boost(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float = 0.3, most_cuts: int = 32, least: int = 10, damp: float = 1.0) -> tuple[float, list[Node]]:
    """Gradient boosting for the logistic loss: the starting logit and the trees (their values include the rate)."""
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return base, []
    cuts = cuts_of(x, most_cuts)
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    score, trees, rows = np.full(len(y), base), [], np.arange(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(binned, cuts, rows, y - p, p * (1 - p), depth, least, damp)
        _scale(tree, rate)
        score = score + tree.predict(x)
        trees.append(tree)
    return base, trees


def _scale(node: Node, rate: float) -> None:
    node.value *= rate
    if node.left is not None:
        _scale(node.left, rate)
        _scale(node.right, rate)


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, below, at in rule:
        out &= (x[:, f] <= at) if below else (x[:, f] > at)
    return out


def rule_column(rule: tuple, features: list[Column]) -> Column:
    out = F.lit(True)
    for f, below, at in rule:
        out = out & ((features[f] <= float(at)) if below else (features[f] > float(at)))
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of logistic regression with an l1 penalty a row, by accelerated proximal steps."""
    n, k = x.shape
    z = np.concatenate([np.ones((n, 1)), x], 1)
    step = 4 * n / max(1e-9, np.linalg.norm(z, 2) ** 2) if n else 1.0
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps if n else 0):
        p = 1 / (1 + np.exp(-(z @ v)))
        u = v - step * (z.T @ (p - y)) / n
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - step * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = u + (t - 1) / s * (u - w), u, s
    return float(w[0]), w[1:]
