"""Gradient-boosted trees on a bounded sample: histogram splits, logistic loss, isotonic calibration. Small numpy helpers for the driver;
scoring all rows happens in Spark, by predict() inside tasks or by the expression of as_column()."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass
class Boosted:
    """Trees over named features; margin() is the log odds, calibrated by a step-wise rising line through (knots, levels)."""

    names: list[str]
    base: float = 0.0
    trees: list[Node] = field(default_factory=list)
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += _value(tree, x)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        if len(self.knots):
            return np.interp(m, self.knots, self.levels)
        return 1 / (1 + np.exp(-m))


def _value(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.threshold, _value(node.left, x), _value(node.right, x))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 60, depth: int = 3, rate: float = 0.2, least: int = 5, bins: int = 32, ridge: float = 1.0, rising: tuple[str, ...] = ()) -> Boosted:
    """Newton boosting. With one class only, the model is the constant prior. No tree falls along a feature named in rising: a split on it has the lower value left, and what grows below on either side
    stays on its side of the middle."""
    p = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Boosted(names, float(np.log(p / (1 - p))))
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = [_cuts(x[:, j], bins, bool(rising)) for j in range(x.shape[1])]
    up = {names.index(r) for r in rising}
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    m = np.full(len(y), model.base)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-m))
        g, h = y - q, np.maximum(q * (1 - q), 1e-6)
        tree = _grow(binned, cuts, g, h, np.arange(len(y)), depth, least, ridge, rate, up, -np.inf, np.inf)
        m += _value(tree, x)
        model.trees.append(tree)
    return model


def _cuts(values: np.ndarray, bins: int, sparse: bool) -> np.ndarray:
    """Where a feature may be split. sparse: a feature that is mostly 0 has cuts at 0 and among its other values too."""
    steps = np.linspace(0, 1, bins + 1)[1:-1]
    some = [np.quantile(values, steps)]
    if sparse:
        other = values[values != 0]
        if len(other):
            some.append(np.quantile(other, steps))
        if len(other) < len(values):
            some.append(np.zeros(1))
    return np.unique(np.concatenate(some))


def _grow(binned, cuts, g, h, rows, depth, least, ridge, rate, up, low, high) -> Node:
    gs, hs = g[rows].sum(), h[rows].sum()
    leaf = Node(value=float(np.clip(rate * gs / (hs + ridge), low, high)))
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best = (1e-6, -1, -1)
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        b = binned[rows, j]
        n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
        gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
        hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
        gain[(n < least) | (len(rows) - n < least)] = -1
        if j in up:
            gain[gl / (hl + ridge) > (gs - gl) / (hs - hl + ridge)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, k)
    if best[1] < 0:
        return leaf
    _, j, k = best
    left = binned[rows, j] <= k
    middle = (low, high, low, high)
    if j in up:
        sides = [np.clip(rate * g[s].sum() / (h[s].sum() + ridge), low, high) for s in (rows[left], rows[~left])]
        middle = (low, sum(sides) / 2, sum(sides) / 2, high)
    below = [_grow(binned, cuts, g, h, s, depth - 1, least, ridge, rate, up, *limits) for s, limits in ((rows[left], middle[:2]), (rows[~left], middle[2:]))]
    return Node(0.0, j, float(cuts[j][k]), *below)


def isotonic(scores: np.ndarray, y: np.ndarray, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators. Returns rising (knots, levels); a pool's level is drawn to the overall rate by prior pseudo-rows,
    so that it never reaches 0 or 1. Needs both classes, else returns empty arrays."""
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(0), np.zeros(0)
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []
    for s, t in zip(scores[order], y[order], strict=True):
        pools.append([float(t), 1.0, float(s), float(s)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            b = pools.pop()
            a = pools[-1]
            pools[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    rate = y.mean()
    knots, levels = [], []
    for total, n, low, high in pools:
        level = (total + prior * rate) / (n + prior)
        for s in (low, high) if high > low else (low,):
            knots.append(s)
            levels.append(level)
    return np.array(knots), np.maximum.accumulate(np.array(levels))


def as_column(model: Boosted, feature):
    """The margin as a Spark expression; feature(name) gives a feature's column."""
    from pyspark.sql import functions as F

    def tree(node: Node):
        if node.feature < 0:
            return F.lit(node.value)
        return F.when(feature(model.names[node.feature]) <= F.lit(node.threshold), tree(node.left)).otherwise(tree(node.right))

    out = F.lit(model.base)
    for t in model.trees:
        out = out + tree(t)
    return out
