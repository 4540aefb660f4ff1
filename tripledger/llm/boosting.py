"""Gradient-boosted trees over small whole-number features, fitted on a table of feature patterns.

The table counts how often each pattern occurs with each label, over all rows; its size is bounded by the
product of the feature ranges. So fitting sees every row and still runs on the driver; scoring is a column
expression.
"""

from __future__ import annotations

from math import exp
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Leaf(NamedTuple):
    value: float


class Split(NamedTuple):
    feature: int
    at_most: int
    low: "Split | Leaf"
    high: "Split | Leaf"


def fit(patterns: list[tuple[tuple[int, ...], float, float]], trees: int = 25, depth: int = 3, rate: float = 0.4) -> list[Split | Leaf]:
    """Trees whose summed values are the log odds of label 1; patterns: (features, count of label 0, count of label 1)."""
    patterns = sorted(patterns)
    odds = [0.0] * len(patterns)
    model: list[Split | Leaf] = []
    for _ in range(trees if patterns else 0):
        gradient, curvature = [], []
        for (_, n0, n1), o in zip(patterns, odds, strict=True):
            p = 1 / (1 + exp(-max(-30.0, min(30.0, o))))
            gradient.append(n1 - (n0 + n1) * p)
            curvature.append((n0 + n1) * p * (1 - p))

        def value(rows: list[int], g: list[float] = gradient, h: list[float] = curvature) -> float:
            return rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1.0)

        def gain(rows: list[int], g: list[float] = gradient, h: list[float] = curvature) -> float:
            return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1.0)

        def grow(rows: list[int], left: int) -> Split | Leaf:
            best, parts = 1e-6 + gain(rows), None
            for f in range(len(patterns[0][0])) if left else ():
                for cut in sorted({patterns[i][0][f] for i in rows})[:-1]:
                    low = [i for i in rows if patterns[i][0][f] <= cut]
                    high = [i for i in rows if patterns[i][0][f] > cut]
                    if (now := gain(low) + gain(high)) > best:
                        best, parts = now, (f, cut, low, high)
            if parts is None:
                return Leaf(value(rows))
            f, cut, low, high = parts
            return Split(f, cut, grow(low, left - 1), grow(high, left - 1))

        tree = grow(list(range(len(patterns))), depth)
        model.append(tree)
        odds = [o + predict(tree, x) for o, (x, _, _) in zip(odds, patterns, strict=True)]
    return model


def predict(tree: Split | Leaf, x: tuple[int, ...]) -> float:
    while isinstance(tree, Split):
        tree = tree.low if x[tree.feature] <= tree.at_most else tree.high
    return tree.value


def score(model: list[Split | Leaf], x: tuple[int, ...]) -> float:
    return 1 / (1 + exp(-max(-30.0, min(30.0, sum(predict(t, x) for t in model)))))


def log_odds(model: list[Split | Leaf], features: list[Column]) -> Column:
    """The model's log odds of a row as one column expression."""

    def column(tree: Split | Leaf) -> Column:
        if isinstance(tree, Leaf):
            return F.lit(float(tree.value))
        return F.when(features[tree.feature] <= tree.at_most, column(tree.low)).otherwise(column(tree.high))

    total = F.lit(0.0)
    for tree in model:
        total = total + column(tree)
    return total
