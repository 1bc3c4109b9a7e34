"""Boosting, nested selection and calibration against plain Python over all rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, calibration, nested

SCHEMA = "id int, year int, a double, b double, y double, base double"


def rows(n=300, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.choice([None, math.nan, *range(6)]), rng.uniform(-1, 1)
        margin = rng.uniform(-1, 1)
        p = 1 / (1 + math.exp(-(margin + (0.8 if b > 0.2 else -0.5) + (1.0 if isinstance(a, int) and a > 3 else 0))))
        out.append((i, 2000 + i % 6, None if a is None else float(a), round(b, 2), float(rng.random() < p), margin))
    return out


def missing(v):
    return v is None or math.isnan(v)


def brute_tree(data, edges, depth, eta, reg, least):
    """data: (values, g, h). Every feature, edge and side for missing values, over the rows themselves."""
    G, H = sum(d[1] for d in data), sum(d[2] for d in data)
    best = None
    for f, e in enumerate(edges):
        for miss in (True, False):
            for k, edge in enumerate([*e, math.inf]):
                left = [d for d in data if (miss if missing(d[0][f]) else d[0][f] <= edge)]
                gl, hl = sum(d[1] for d in left), sum(d[2] for d in left)
                if hl < least or H - hl < least:
                    continue
                gain = gl * gl / (hl + reg) + (G - gl) ** 2 / (H - hl + reg) - G * G / (H + reg)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, k, miss, left)
    if not depth or best is None:
        return -eta * G / (H + reg)
    _, f, k, miss, left = best
    own = {id(d) for d in left}
    return boosting.Split(f, k, miss, brute_tree(left, edges, depth - 1, eta, reg, least), brute_tree([d for d in data if id(d) not in own], edges, depth - 1, eta, reg, least))


def value(tree, x, edges):
    while isinstance(tree, boosting.Split):
        v = x[tree.feature]
        tree = tree.left if (tree.missing_left if missing(v) else v <= [*edges[tree.feature], math.inf][tree.bin]) else tree.right
    return tree


def same(a, b):
    if isinstance(a, boosting.Split):
        return (a.feature, a.bin, a.missing_left) == (b.feature, b.bin, b.missing_left) and same(a.left, b.left) and same(a.right, b.right)
    return a == pytest.approx(b, abs=1e-9)


@pytest.mark.parametrize("depth,every", [(1, 10), (2, 2), (3, 1)])
def test_boosting_equals_a_search_over_rows(spark, depth, every):
    data, edges = rows(), [[0.0, 1.0, 2.0, 3.0, 4.0], [-0.5, 0.0, 0.2, 0.5]]
    df = spark.createDataFrame([*data, (999, 2000, 1.0, 0.0, None, 0.0)], SCHEMA).repartition(3)
    model = boosting.boost(df, ["a", "b"], "y", F.col("base"), edges, rounds=4, depth=depth, eta=0.3, least=2.0, every=every)
    margin = [r[5] for r in data]
    for tree in model.trees:
        p = [1 / (1 + math.exp(-m)) for m in margin]
        want = brute_tree([((r[2], r[3]), q - r[4], q * (1 - q)) for r, q in zip(data, p)], edges, depth, 0.3, 1.0, 2.0)
        assert same(tree, want)
        margin = [m + value(tree, (r[2], r[3]), edges) for m, r in zip(margin, data)]
    got = {r.id: r.m for r in df.select("id", model.margin(F.col("base")).alias("m")).collect()}
    assert all(got[r[0]] == pytest.approx(m, abs=1e-9) for r, m in zip(data, margin))
    losses = boosting.round_losses(df, model, "y", F.col("base"))
    assert len(losses) == 5 and losses == sorted(losses, reverse=True)  # falls on the rows learnt from


def test_boosting_learns_what_the_market_leaves(spark):
    df = spark.createDataFrame(rows(4000, 1), SCHEMA)
    model = boosting.boost(df.where("id < 2000"), ["a", "b"], "y", F.col("base"), rounds=12, eta=0.2)
    losses = boosting.round_losses(df.where("id >= 2000"), model, "y", F.col("base"))
    assert losses[-1] < losses[0] - 0.02 and len(model.edges[1]) <= 31
    none = boosting.boost(df.limit(0), ["a", "b"], "y", F.col("base"), rounds=2)
    assert df.select(none.margin(F.col("base")).alias("m"), "base").where("m <> base").count() == 0


def test_nested_selection_equals_refitting(spark):
    data = [r for r in rows(600, 2) if not missing(r[2])]
    sets, regs, alphas = {"a": ["a"], "ab": ["a", "b"], "b": ["b"]}, [1.0, 50.0], [0.5, 1.0]
    df = spark.createDataFrame([*data, (-1, 2001, None, 0.3, 1.0, 0.1)], SCHEMA)
    got = nested.nested_selection(df, "year", ["a", "b"], F.col("y") - F.col("base"), sets, regs, alphas, 2).orderBy("test_year").collect()
    delta = {}
    for year, (name, cols), reg, alpha in itertools.product(range(2002, 2006), sets.items(), regs, alphas):
        pick = lambda rs: np.array([[r["ab".index(c) + 2] for c in cols] for r in rs])  # noqa: E731, B023
        train, test = [r for r in data if r[1] < year], [r for r in data if r[1] == year]
        x, t = pick(train), np.array([r[4] - r[5] for r in train])
        w = np.linalg.solve(x.T @ x + reg * np.eye(len(cols)), x.T @ t)
        e = np.array([r[4] - r[5] for r in test])
        delta[year, name, reg, alpha] = np.mean((e - alpha * pick(test) @ w) ** 2) - np.mean(e**2)
    want = []
    for year in range(2003, 2006):
        mean = {k: np.mean([delta[y, *k] for y in range(2002, year)]) for k in itertools.product(sets, regs, alphas)}
        best = min(mean, key=lambda k: (round(mean[k], 12), k[2], -k[1], k[0]))
        want.append((year, *best, year - 2002, mean[best], delta[year, *best]))
    assert [(r.test_year, r.feature_set, r.reg, r.alpha, r.validations) for r in got] == [w[:5] for w in want]
    assert all((r.validation_delta, r.test_delta) == pytest.approx(w[5:], abs=1e-9) for r, w in zip(got, want))


@pytest.mark.parametrize("n,parts", [(1, 1), (40, 3), (800, 7)])
def test_isotonic_is_the_best_rising_function(spark, n, parts):
    rng = random.Random(n)
    data = [(round(rng.random(), 2), float(rng.random() < 0.5), rng.choice([1.0, 2.0])) for _ in range(n)]
    df = spark.createDataFrame([*data, (None, 1.0, 1.0), (0.5, None, 1.0)], "s double, y double, w double").repartition(parts)
    pools = calibration.isotonic(df, F.col("s"), F.col("y"), F.col("w"))
    xs = sorted({s for s, _, _ in data})
    mean = lambda a, b: sum(y * w for s, y, w in data if a <= s <= b) / sum(w for s, _, w in data if a <= s <= b)
    table = {(a, b): mean(a, b) for a in xs for b in xs if a <= b}
    want = {x: max(min(table[a, b] for b in xs if b >= x) for a in xs if a <= x) for x in xs}  # the max-min formula
    got = {r.s: r.calibrated for r in calibration.recalibrated(df.where("s IS NOT NULL AND y IS NOT NULL"), pools, "s").collect()}
    assert got == pytest.approx(want, abs=1e-9)
    found = sorted(pools.collect())
    assert all(a.hi < b.lo and a.value < b.value for a, b in itertools.pairwise(found))
    assert calibration.recalibrated(df, pools, "s").where("s IS NULL").first().calibrated is None
    nothing = calibration.isotonic(df.limit(0), F.col("s"), F.col("y"))
    assert nothing.count() == 0 and {r.calibrated for r in calibration.recalibrated(df, nothing, "s").collect()} == {None}


def test_platt_finds_the_distortion(spark):
    rng = random.Random(3)
    data = [(x := rng.gauss(0, 1), float(rng.random() < 1 / (1 + math.exp(-(0.5 * x - 0.7))))) for _ in range(6000)]
    a, b = calibration.platt(spark.createDataFrame(data, "x double, y double"), F.col("x"), F.col("y"))
    p = np.array([1 / (1 + math.exp(-(a * x + b))) for x, _ in data])
    xs, ys = np.array(data).T
    assert abs(((p - ys) * xs).sum()) < 1e-6 and abs((p - ys).sum()) < 1e-6 and a == pytest.approx(0.5, abs=0.1) and b == pytest.approx(-0.7, abs=0.1)
    assert calibration.platt(spark.createDataFrame([(0.1, 1.0), (0.2, 1.0)], "x double, y double"), F.col("x"), F.col("y")) == (1.0, 0.0)
