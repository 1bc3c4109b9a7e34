"""Partners and variants counted without pairs or lists, and ordered scans a batch at a time, against plain Python."""

import random
from datetime import datetime, timedelta

import pytest

import __spark_entry__ as entry
from tidemark.operators import identity, joins, state

T0 = datetime(1969, 12, 31, 12)


def _joined(df):
    """The result, and the most rows that a join of its plan made."""
    rows, todo, most = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if "Join" in name:
            most = max(most, p.metrics().get("numOutputRows").get().value())
        todo += [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if name.endswith("QueryStage") else [p.children().apply(i) for i in range(p.children().size())]
    return rows, most


@pytest.mark.parametrize("seed", range(4))
def test_sole_partners_equal_all_pairs_counted(spark, seed):
    rng = random.Random(seed)
    at = lambda: None if rng.random() < 0.03 else T0 + timedelta(seconds=rng.randint(0, 4000), microseconds=rng.choice([0, 0, 1]))
    some = lambda n: [(rng.choice([*range(n), *range(n), None]), rng.choice("abc"), rng.choice(["a", "b", "d", None]), at()) for _ in range(n)]  # noqa: E731 - ids repeat
    left, right = some(160), some(120)
    l, r = spark.createDataFrame(left, "id int, h string, a string, t timestamp").repartition(3), spark.createDataFrame(right, "other int, h string, a string, u timestamp").repartition(3)  # noqa: E741
    for s in (0, 60, 600):
        near = lambda x, y: x[3] and y[3] and abs(x[3] - y[3]) <= timedelta(seconds=s)  # noqa: E731, B023
        pairs = [(x, y) for x in left for y in right if None not in (x[1], x[2], y[1], y[2]) and {x[1], x[2]} == {y[1], y[2]} and sorted(x[1:3]) == sorted(y[1:3]) and near(x, y)]
        ids, others = [x[0] for x, _ in pairs], [y[0] for _, y in pairs]
        want = [(*x, *(y[0], y[3]), y[1] != x[1]) for x, y in pairs if ids.count(x[0]) == 1 and others.count(y[0]) == 1]
        got = joins.pair_tolerance_join(l, r, ("h", "a"), "t", "u", s, "id", "other")
        assert got.columns == ["id", "h", "a", "t", "other", "u", "swapped"]
        assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(want, key=str)
        pairs = [(x, y) for x in left for y in right if x[1] == y[1] and near(x, y)]
        ids = [x[0] for x, _ in pairs]
        want = [(x[1], x[0], x[3], y[0], y[3]) for x, y in pairs if ids.count(x[0]) == 1]
        got = joins.tolerance_join(l.drop("a"), r.drop("a"), "h", "t", "u", s, "id")
        assert got.columns == ["h", "id", "t", "other", "u"]
        assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(want, key=str)


def test_crowded_times_make_no_pairs(spark):
    n = 300
    l = spark.range(n).selectExpr("id", "'x' AS h", "'y' AS a", "timestamp_seconds(id % 7) AS t")  # noqa: E741
    r = spark.range(n).selectExpr("id AS other", "'y' AS h", "'x' AS a", "timestamp_seconds(id % 7) AS u")
    for df in (joins.pair_tolerance_join(l, r, ("h", "a"), "t", "u", 60, "id", "other"), joins.tolerance_join(l.drop("a"), r.withColumnRenamed("h", "g").withColumnRenamed("a", "h").drop("g"), "h", "t", "u", 60, "id")):
        rows, most = _joined(df)
        assert rows == [] and most <= 2 * n  # all pairs: 90,000


@pytest.mark.parametrize("kind", ["elo", "scoreline"])
def test_scans_hold_a_batch_and_not_a_league(spark, kind):
    """The same rows from batches of 64 as from one, with leagues, teams and scores missing; no plan step takes a league whole."""
    rng = random.Random(7)
    some = lambda *v: rng.choice([*v, *v, *v, *v, None])
    teams = (lambda: (some("a", "b", "c"), some("d", "e", "f"))) if kind == "elo" else lambda: (rng.choice("abc"), rng.choice("def"))
    rows = [(i, some("x", "x", "y", "z"), (T0 + timedelta(days=rng.randint(1, 900))).date(), *teams(), some(0, 1, 2), some(0, 1, 3)) for i in range(1500)]
    m = spark.createDataFrame(rows, "match_id long, league string, match_date date, home string, away string, hg int, ag int").repartition(5)
    got = []
    for n in (64, 100_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            out = getattr(state, kind)(m)
            got.append(sorted((tuple(r) for r in out.collect()), key=str))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" in plan and "FlatMapGroups" not in plan
    assert got[0] == got[1] and len(got[0]) == (4 * len(rows) if kind == "scoreline" else sum(None not in r[3:5] for r in rows))
    if kind == "elo":  # the recursion over the leagues written out
        rating, want = {}, []
        for i, lg, _, h, a, hg, ag in sorted(rows, key=lambda r: (r[2], r[0])):
            if None not in (h, a):
                x, y = rating.get((lg, h), 1500.0), rating.get((lg, a), 1500.0)
                p = 1 / (1 + 10 ** ((y - x - 60) / 400))
                want.append((i, x, y, p))
                if None not in (hg, ag):
                    s = 20 * ((1.0 if hg > ag else 0.5 if hg == ag else 0.0) - p)
                    rating[lg, h], rating[lg, a] = x + s, y - s
        assert {r[0]: r[1:] for r in got[0]} == {r[0]: pytest.approx(r[1:], abs=1e-9) for r in want}


def test_conflicts_equal_sets_written_out(spark):
    rng = random.Random(3)
    rows = [(rng.choice([*range(150), None]), rng.choice([0, 1, 1, 2, None]), rng.choice(["x", "x", "x", "y", None]), rng.choice([1, 1, 1, 2])) for _ in range(600)]
    want = {}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        top = min((r[1] for r in own if r[1] is not None), default=None)
        n, t = len({r[2:] for r in own}), len({r[2:] for r in own if r[1] == top and top is not None})
        want[k] = (len(own), n, "none" if n <= 1 else "resolved_by_source_priority" if t <= 1 else "quarantined")
    got = identity.conflict_status(spark.createDataFrame(rows, "k int, p int, v string, w int").repartition(4), ["k"], "p", ["v", "w"])
    assert {r.k: (r.n_rows, r.n_variants, r.status) for r in got.collect()} == want and len(set(x[2] for x in want.values())) == 3
    assert {r.k: r.status for r in got.select("k", "status").collect()} == {k: x[2] for k, x in want.items()}


def test_conflict_status_shuffles_its_rows_once(spark):
    df = entry.queries()["dedup_conflict_status"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning(l_orderkey") == 1
