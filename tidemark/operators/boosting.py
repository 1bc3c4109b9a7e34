"""Boosted trees that start at the market: histogram boosting of the logistic loss with a base margin.

Feature values become bin numbers once. A level of a tree is one aggregation: sums of gradients and hessians for each
node, feature and bin, combined where the rows are, so that what reaches the driver is nodes x features x bins rows
however many rows are learnt from. The driver picks the splits; a tree is then an expression over the bin columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.cuts import cut


@dataclass(frozen=True)
class Split:
    """Rows whose bin is at most `bin` go left (the last bin: all that have a value); rows without a value go left if
    `missing_left`. A side is a split or what it adds to the margin."""

    feature: int
    bin: int
    missing_left: bool
    left: Split | float
    right: Split | float


def quantile_edges(df: DataFrame, features: list[str], bins: int = 32) -> list[list[float]]:
    """Upper edges of the bins of each feature: approximate quantiles, all in one pass."""
    at = [(k + 1) / bins for k in range(bins - 1)]
    row = df.agg(*[F.percentile_approx(_value(c), at, 10_000).alias(str(i)) for i, c in enumerate(features)]).first()
    return [sorted(set(v or [])) for v in row]


def _value(column: str) -> Column:
    """A double; NaN is missing too."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def bin_of(column: str, edges: list[float]) -> Column:
    """How many edges lie below the value; -1 without one."""
    x = _value(column)
    return F.when(x.isNull(), -1).otherwise(sum(((x > e).cast("int") for e in edges), F.lit(0)))


def _grown(tree: Split | float, go: list, leaf) -> Column:
    """A tree as one expression; go[f](bin): whether a row's feature f is in a bin up to that, NULL without a value."""
    if isinstance(tree, Split):
        return F.when(F.coalesce(go[tree.feature](tree.bin), F.lit(tree.missing_left)), _grown(tree.left, go, leaf)).otherwise(_grown(tree.right, go, leaf))
    return leaf(tree)


@dataclass
class Boosted:
    features: list[str]
    edges: list[list[float]]
    eta: float
    trees: list[Split | float] = field(default_factory=list)

    def margin(self, base: Column, rounds: int | None = None) -> Column:
        """base and what the first `rounds` trees add, from the features' own values."""
        return sum((_grown(t, self.sides(), F.lit) for t in self.trees[:rounds]), base)

    def sides(self) -> list:
        """For _grown: the upper edge of a bin, none for the last, against a feature's value."""
        return [lambda k, c=c, e=e: _value(c) <= F.lit(e[k] if k < len(e) else math.inf) for c, e in zip(self.features, self.edges)]

    def probability(self, base: Column, rounds: int | None = None) -> Column:
        return 1 / (1 + F.exp(-self.margin(base, rounds)))


def best_split(g: np.ndarray, h: np.ndarray, reg: float, least: float) -> tuple[float, int, int, bool] | None:
    """(gain, feature, bin, missing_left) from sums by feature and bin, bin 0 being the rows without a value.

    Ties go to the first feature, then the lowest bin, then to missing on the left.
    """
    best = None
    for f in range(len(g)):
        total_g, total_h = g[f].sum(), h[f].sum()
        for missing_left in (True, False):
            left_g, left_h = np.cumsum(g[f][1:]) + missing_left * g[f][0], np.cumsum(h[f][1:]) + missing_left * h[f][0]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + reg) + right_g**2 / (right_h + reg) - total_g**2 / (total_h + reg)
            gain = np.where((left_h >= least) & (right_h >= least), gain, -np.inf)
            k = int(np.argmax(gain > gain.max() - 1e-9)) if len(gain) else 0
            if len(gain) and gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-9):
                best = (float(gain[k]), f, k, missing_left)
    return best


def boost(df: DataFrame, features: list[str], label: str, base: Column, edges: list[list[float]] | None = None, weight: Column | None = None, rounds: int = 20, depth: int = 2, eta: float = 0.1, reg: float = 1.0, least: float = 1.0, every: int = 10) -> Boosted:
    """Trees on the logistic loss of label (0 or 1) from the margin `base` on.

    A leaf adds -eta * G / (H + reg); a split needs a hessian of `least` on both sides. Rows without a label or margin are
    left out; values that are missing go where they lessen the loss. The binned rows are written once, and their
    margins again after every `every` trees, so that neither lineage nor expressions grow with the rounds.
    """
    model = Boosted(features, edges if edges is not None else quantile_edges(df, features), eta)
    bins = [bin_of(c, e).cast("short").alias(f"b{i}") for i, (c, e) in enumerate(zip(features, model.edges))]
    rows = df.select(F.col(label).cast("double").alias("y"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"), base.alias("m"), *bins)
    rows = cut(rows.where(F.col("y").isNotNull() & F.col("m").isNotNull()), "boost")
    width, go = max(map(len, model.edges), default=0) + 2, [lambda k, i=i: F.when(F.col(f"b{i}") >= 0, F.col(f"b{i}") <= k) for i in range(len(features))]
    fresh: list[Split | float] = []
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-sum((_grown(t, go, F.lit) for t in fresh), F.col("m"))))
        scored = rows.withColumn("p", p).select("*", (F.col("w") * (F.col("p") - F.col("y"))).alias("g"), (F.col("w") * F.col("p") * (1 - F.col("p"))).alias("h"))
        tree = _tree(scored, len(features), width, go, depth, eta, reg, least)
        model.trees.append(tree)
        fresh.append(tree)
        if len(fresh) >= every:
            rows = cut(rows.withColumn("m", sum((_grown(t, go, F.lit) for t in fresh), F.col("m"))), "boost")
            fresh = []
    return model


def _tree(rows: DataFrame, n_features: int, width: int, go: list, depth: int, eta: float, reg: float, least: float) -> Split | float:
    splits: dict[int, tuple[int, int, bool]] = {}  # by node: the root is 1, children 2n and 2n + 1
    value: dict[int, float] = {}

    def build(node: int, leaf) -> Split | float:
        if node in splits:
            f, k, m = splits[node]
            return Split(f, k, m, build(2 * node, leaf), build(2 * node + 1, leaf))
        return leaf(node)

    level = [1]
    for d in range(depth):
        node = _grown(build(1, float), go, lambda n: F.lit(int(n)))
        cell = F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b{i}").alias("b")) for i in range(n_features)]))
        sums = rows.select(node.alias("node"), "g", "h", cell).groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        g, h = ({n: np.zeros((n_features, width)) for n in level} for _ in range(2))
        for r in sums.collect():  # nodes x features x bins
            if r.node in g:
                g[r.node][r.f, r.b + 1], h[r.node][r.f, r.b + 1] = r.g, r.h
        found = []
        for n in level:
            total_g, total_h = g[n][0].sum(), h[n][0].sum()
            value[n] = -eta * total_g / (total_h + reg)
            if split := best_split(g[n], h[n], reg, least):
                _, f, k, m = split
                left_g, left_h = g[n][f, 1 : k + 2].sum() + m * g[n][f, 0], h[n][f, 1 : k + 2].sum() + m * h[n][f, 0]
                splits[n] = (f, k, m)
                value[2 * n], value[2 * n + 1] = -eta * left_g / (left_h + reg), -eta * (total_g - left_g) / (total_h - left_h + reg)
                found += [2 * n, 2 * n + 1]
        level = found
        if not level:
            break
    return build(1, lambda n: float(value.get(n, 0.0)))


def round_losses(df: DataFrame, model: Boosted, label: str, base: Column) -> list[float]:
    """The mean log loss after 0, 1, .. trees, in one pass: where it is least is where to stop."""
    y = F.col(label).cast("double")
    add = [F.col("__m"), *[F.col(f"__t{k}") for k in range(len(model.trees))]]
    rows = df.select(y.alias("__y"), base.alias("__m"), *[_grown(t, model.sides(), F.lit).alias(f"__t{k}") for k, t in enumerate(model.trees)])
    margins = [sum(add[1 : k + 1], add[0]) for k in range(len(add))]
    losses = [F.avg(F.log1p(F.exp(-F.abs(m))) + F.greatest(m, F.lit(0.0)) - m * F.col("__y")) for m in margins]
    return [math.nan if v is None else v for v in rows.agg(*losses).first()]
