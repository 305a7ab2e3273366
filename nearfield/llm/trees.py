"""Small decision trees: grown in numpy on a bounded labelled sample, applied as plain column expressions.

A tree is a float (a leaf) or (feature, threshold, left, right); rows with feature <= threshold go left.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = float | tuple


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, features: np.ndarray, least: int, bins: int) -> tuple[float, int, float]:
    """Best gain with its feature and threshold; thresholds lie between the distinct values or quantiles."""
    best = (1e-9, -1, 0.0)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in features:
        values = np.unique(x[:, f])
        if len(values) > bins:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)))
        for low, high in zip(values[:-1], values[1:], strict=True):
            threshold = round(float(low + high) / 2, 6)
            left = x[:, f] <= threshold
            n = int(left.sum())
            if n < least or len(x) - n < least:
                continue
            gl, hl = g[left].sum(), h[left].sum()
            gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - whole
            if gain > best[0]:
                best = (gain, int(f), threshold)
    return best


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int = 5, bins: int = 24, rng: np.random.Generator | None = None, share: float = 1.0) -> Tree:
    """A tree whose leaves are g/(h+1) summed over their rows; each split looks at a share of the features if rng is given."""
    features = np.arange(x.shape[1])
    if rng is not None:
        features = rng.choice(features, max(1, round(share * len(features))), replace=False)
    _, f, threshold = _split(x, g, h, features, least, bins) if depth and len(x) >= 2 * least else (0, -1, 0)
    if f < 0:
        return round(float(g.sum() / (h.sum() + 1.0)), 6)
    left = x[:, f] <= threshold
    return f, threshold, *(grow(x[k], g[k], h[k], depth - 1, least, bins, rng, share) for k in (left, ~left))


def value(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, threshold, left, right = tree
    return np.where(x[:, f] <= threshold, value(left, x), value(right, x))


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.4) -> list[Tree]:
    """Gradient boosting of the logistic loss; the sum of the trees is the log odds of y = 1."""
    trees: list[Tree] = []
    odds = np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        trees.append(grow(x, rate * (y - p), p * (1 - p), depth))
        odds += value(trees[-1], x)
    return trees


def forest(x: np.ndarray, y: np.ndarray, count: int = 15, depth: int = 5, seed: int = 3) -> list[Tree]:
    """A random forest: bootstrap rows, half of the features at each split; the mean of the trees is the share of y = 1."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        rows = rng.integers(0, len(x), len(x))
        out.append(grow(x[rows], y[rows].astype(float), np.ones(len(x)), depth, rng=rng, share=0.5))
    return out


def _column(tree: Tree, features: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, threshold, left, right = tree
    return F.when(features[f] <= F.lit(float(threshold)), _column(left, features)).otherwise(_column(right, features))


def total(trees: list[Tree], features: list[Column]) -> Column:
    """The sum of the trees as an expression of the feature columns."""
    return reduce(lambda a, b: a + b, [_column(t, features) for t in trees], F.lit(0.0))


def total_sql(trees: list[Tree], features: list[str]) -> str:
    """The same sum as SQL text."""

    def text(tree: Tree) -> str:
        if not isinstance(tree, tuple):
            return f"{float(tree):.6f}e0"
        f, threshold, left, right = tree
        return f"CASE WHEN {features[f]} <= {float(threshold):.6f}e0 THEN {text(left)} ELSE {text(right)} END"

    return "0e0" + "".join(f"\n  + {text(t)}" for t in trees)
