"""What filters, blocks and order checks refuse."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import context, selection
from tidemark.operators.joins import CardinalityError


def test_a_block_must_be_unique_and_keeps_every_row(spark):
    base = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, v string")
    block = spark.createDataFrame([(1, 5), (3, 6)], "k int, v int")
    got = context.feature_block(base, block, ["k"], "b")
    assert got.columns == ["k", "v", "b_v", "has_b"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "x", 5, True), (1, "y", 5, True), (2, "z", None, False), (None, "n", None, False)], key=str)
    with pytest.raises(CardinalityError):
        context.feature_block(base, block.unionAll(block), ["k"], "b")


def test_parts_that_overlap_are_refused(spark):
    rows = [(1, "train", 1, 10), (1, "tune", 2, 11), (1, "test", 3, 12), (2, "train", 1, 10), (2, "tune", 1, 12), (2, "test", 3, 13)]
    df = spark.createDataFrame(rows, "fold int, role string, season int, d int")
    checks = context.order_checks(df, "fold", "role", ["train", "tune", "test"], "d", "season")
    assert {(r.fold, r.earlier): (r.dates_apart, r.seasons_apart) for r in checks.collect()} == {(1, "train"): (True, True), (1, "tune"): (True, True), (2, "train"): (True, False), (2, "tune"): (True, True)}
    context.assert_order(checks.where("fold = 1"))
    with pytest.raises(context.OrderError, match="fold 2: tune begins before train"):
        context.assert_order(checks)


def test_segments_and_scaling_with_nothing_in_them(spark):
    df = spark.createDataFrame([(1, None), (1, 5.0), (2, 10.0), (2, 10.1)], "k int, a double")
    got = {(r.k, r.segment): r.rows for r in context.staleness(df, ["k"], F.col("a"), [5, 10]).collect()}
    assert got == {(1, "missing"): 1, (1, "<= 5"): 1, (2, "(5, 10]"): 1, (2, "> 10"): 1}
    flat = context.standardised(df.withColumn("a", F.lit(3.0)), ["a"], F.lit(True))
    assert {r.a_z for r in flat.collect()} == {0.0}
    none = context.standardised(df, ["a"], F.lit(False))
    assert {r.a_z for r in none.collect()} == {None}


def test_rules_are_sets_of_conditions(spark):
    df = spark.createDataFrame([(1, True, True), (2, True, None), (3, False, True)], "i int, a boolean, b boolean")
    rules = {"both": ("a", "b"), "first": ("a",), "any": ()}
    got = {r.i: r.m for r in df.select("i", selection.rules_met(rules, {"a": F.col("a"), "b": F.col("b")}).alias("m")).collect()}
    assert got == {1: ["both", "first", "any"], 2: ["first", "any"], 3: ["any"]}
    with pytest.raises(KeyError):
        selection.rules_met({"x": ("unknown",)}, {})


def test_noise_has_the_spread_of_the_fitted_rows_and_repeats(spark):
    df = spark.range(4000).select("id", (F.col("id") % 7).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    once, again = (selection.noise_replaced(d, ["x", "y"], F.col("id") < 2000, "id", "s") for d in (df, df.repartition(5)))
    a, b = ({r.id: (r.x, r.y) for r in d.collect()} for d in (once, again))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    s = once.agg(F.avg("x").alias("m"), F.stddev("x").alias("d"), F.avg("y").alias("n"), F.stddev("y").alias("e")).first()
    assert s.m == pytest.approx(3, abs=0.15) and s.d == pytest.approx(2, abs=0.1) and s.n == pytest.approx(0, abs=0.08) and s.e == pytest.approx(1, abs=0.05)
