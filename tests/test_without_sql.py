"""Recursive and fitted queries against the recursion written out, and held-out rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import models
from tidemark.plans.base import fixtures

SF = "/root/testdata/sf0.001"


def test_elo_ratings_follow_the_recursion(spark):
    rows = sorted(fixtures(spark, SF).collect(), key=lambda r: (r.match_date, r.match_id))
    rating, want = {}, {}
    for r in rows:
        h, a = rating.get((r.league, r.home), 1500.0), rating.get((r.league, r.away), 1500.0)
        p = 1 / (1 + 10 ** ((a - h - 60) / 400))
        want[r.match_id] = (h, a, p)
        s = 1.0 if r.hg > r.ag else 0.5 if r.hg == r.ag else 0.0
        rating[r.league, r.home], rating[r.league, r.away] = h + 20 * (s - p), a - 20 * (s - p)
    got = {r.match_id: (r.home_elo_pre, r.away_elo_pre, r.p_home) for r in entry.queries()["elo_ratings"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_scoreline_follows_the_recursion(spark):
    got = {(r.match_id, r.candidate): r for r in entry.queries()["dynamic_scoreline"](spark, SF).collect()}
    rows = sorted(fixtures(spark, SF).collect(), key=lambda r: (r.match_date, r.home, r.away, r.match_id))
    history, league = {}, {}
    for r in rows:
        day = r.match_date.toordinal()
        past, goals = [history.get((r.league, t), []) for t in (r.home, r.away)], league.setdefault(r.league, [])
        own = got[r.match_id, "dc_decay_1_0_prior_20"]
        assert own.prior_matches == min(map(len, past)) and own.rho == -0.05
        weigh = lambda i, k: sum(m[k] * math.exp(-1.0 * (day - m[0]) / 365.25) for m in past[i])  # noqa: E731, B023
        base = [(sum(g[i] for g in goals) + p * 20) / (len(goals) + 20) for i, p in ((0, 1.35), (1, 1.10))]
        rate = lambda i: (weigh(i, 1) + base[i] * 20) / (weigh(i, 3) + 20) * (weigh(1 - i, 2) + base[i] * 20) / (weigh(1 - i, 3) + 20) / max(base[i], 0.2)  # noqa: E731, B023
        assert [own.rate_home, own.rate_away] == pytest.approx([min(max(rate(i), 0.15), 4.5) for i in (0, 1)], abs=2e-6)
        assert own.home_staleness == (day - past[0][-1][0] if past[0] else None)
        history.setdefault((r.league, r.home), []).append((day, r.hg, r.ag, 1))
        history.setdefault((r.league, r.away), []).append((day, r.ag, r.hg, 1))
        goals.append((r.hg, r.ag))
    assert len(got) == 4 * len(rows)


def test_logistic_learns_from_train_rows_only(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2))
    y = (rng.random(600) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    df = spark.createDataFrame([(int(i), float(a) if i % 9 else None, float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id int, a double, b double, y double")
    model = models.logistic(["a", "b"], "y").fit(df.where("id < 400"))
    test = models.scored(model, df.where("id >= 400")).toPandas()
    assert ((test.p > 0.5) == (test.y == 1)).mean() > 0.7
    again = models.scored(model, df.where("id >= 400").withColumn("y", 1 - F.col("y"))).toPandas()
    assert np.allclose(test.p, again.p)
