"""Small gradient-boosted trees: fitted with numpy on a bounded set, applied as a Column expression."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple  # (feature, threshold, left, right) or (value,)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> Tree:
    best, at = 1e-6, None
    if depth:
        whole = g.sum() ** 2 / (h.sum() + ridge)
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, gs, hs = x[order, j], g[order].cumsum(), h[order].cumsum()
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            gain = gs[cuts] ** 2 / (hs[cuts] + ridge) + (gs[-1] - gs[cuts]) ** 2 / (hs[-1] - hs[cuts] + ridge) - whole
            k = int(gain.argmax())
            if gain[k] > best:
                best, at = gain[k], (j, float(v[cuts[k]] + v[cuts[k] + 1]) / 2)
    if at is None:
        return (float(-g.sum() / (h.sum() + ridge)),)
    left = x[:, at[0]] <= at[1]
    return (*at, _grow(x[left], g[left], h[left], depth - 1, ridge), _grow(x[~left], g[~left], h[~left], depth - 1, ridge))


def _value(tree: Tree, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] <= tree[1], _value(tree[2], x), _value(tree[3], x))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> list[Tree]:
    """Logistic loss, second-order steps."""
    z, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(x, p - y, p * (1 - p), depth, ridge)
        z += rate * _value(tree, x)
        out.append(_scaled(tree, rate))
    return out


def _scaled(tree: Tree, by: float) -> Tree:
    return (tree[0] * by,) if len(tree) == 1 else (*tree[:2], _scaled(tree[2], by), _scaled(tree[3], by))


def margin(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return sum((_value(t, x) for t in trees), np.zeros(len(x)))


def expression(trees: list[Tree], feature: Callable[[int], Column]) -> Column:
    """The sum of the trees over features, as nested conditions."""

    def one(t: Tree) -> Column:
        if len(t) == 1:
            return F.lit(t[0])
        return F.when(feature(t[0]) <= t[1], one(t[2])).otherwise(one(t[3]))

    out = F.lit(0.0)
    for t in trees:
        out = out + one(t)
    return out
