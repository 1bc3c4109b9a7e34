import bz2
import json
import sqlite3
import zipfile
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import contracts, evaluation, identity, joins, models, replay, state, windows
from tidemark.sources import readers, sinks
from tidemark.streaming import replay as streaming


def test_same_day_rows_are_not_history(spark):
    rows = [(1, "a", date(2024, 1, 1), 2), (2, "a", date(2024, 1, 6), 1), (3, "a", date(2024, 1, 6), 4), (4, "a", date(2024, 1, 11), 0)]
    df = spark.createDataFrame(rows, "id int, team string, match_date date, gf int")
    out = windows.last_n(df, "gf", ["team"], 5, ["id"], "h").select("id", windows.rest_days(["team"]).alias("rest"), windows.mean(F.col("h")).alias("m"), F.count(F.lit(1)).over(windows.last_days(["team"], 7)).alias("n7")).orderBy("id").collect()
    assert [(r.rest, r.m, r.n7) for r in out] == [(14, None, 0), (5, 2.0, 1), (5, 2.0, 1), (5, pytest.approx(7 / 3), 2)]


def test_drawdown_versions(spark):
    df = spark.createDataFrame([("x", i, p) for i, p in enumerate([-1.0, 2.0, -3.0, 1.0])], "k string, i int, profit double")
    got = [windows.drawdown(df, ["k"], ["i"], "profit", v).first().max_drawdown for v in (1, 2, 3)]
    assert got == [3.0, -3.0, 3.0]
    down = spark.createDataFrame([("x", 0, -1.0)], "k string, i int, profit double")
    assert [windows.drawdown(down, ["k"], ["i"], "profit", v).first().max_drawdown for v in (1, 3)] == [0.0, 1.0]
    assert windows.losing_streak(df, ["k"], ["i"], "profit").first().longest_losing_streak == 1


@pytest.mark.parametrize(("strict", "want"), [(True, 10), (False, 20)])
def test_asof(spark, strict, want):
    left = spark.createDataFrame([("k", 5, 1), ("z", 5, 2)], "k string, t int, id int")
    right = spark.createDataFrame([("k", 3, 10), ("k", 5, 20), ("k", 7, 30)], "k string, rt int, v int")
    out = {r.id: r.v for r in joins.asof(left, right, ["k"], "t", "rt", ["v"], strict).collect()}
    assert out == {1: want, 2: None}
    assert "Join" not in joins.asof(left, right, ["k"], "t", "rt", ["v"])._jdf.queryExecution().executedPlan().toString()


def test_validated_join_raises(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(joins.CardinalityError):
        joins.validated_join(a, b, ["k"])
    assert joins.validated_join(b, a, ["k"]).count() == 2


def test_interval_and_tolerance(spark):
    l = spark.createDataFrame([(1, "a", date(2024, 1, 5))], "id int, k string, d date")  # noqa: E741
    iv = spark.createDataFrame([("a", None, None, "open"), ("a", date(2024, 1, 1), date(2024, 1, 5), "past"), ("a", date(2024, 1, 5), date(2024, 2, 1), "now")], "k string, s date, e date, v string")
    assert joins.interval_join(l, iv, ["k"], "d", "s", "e", [F.col("e").isNotNull().desc()]).first().v == "now"
    ts = lambda h: datetime(2024, 1, 1, h)
    a = spark.createDataFrame([(1, "a", ts(10)), (2, "b", ts(10))], "id int, k string, t timestamp")
    b = spark.createDataFrame([("a", ts(11), 1), ("b", ts(9), 2), ("b", ts(11), 3)], "k string, u timestamp, v int")
    assert [(r.id, r.v) for r in joins.tolerance_join(a, b, "k", "t", "u", 7200, "id").collect()] == [(1, 1)]


def test_conflicts_and_upsert(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "x"), (2, 0, "y"), (3, 0, "x"), (3, 1, "x")], "k int, p int, v string")
    got = {r.k: r.status for r in identity.conflict_status(df, ["k"], "p", ["v"]).collect()}
    assert got == {1: "resolved_by_source_priority", 2: "quarantined", 3: "none"}
    up = identity.upsert(spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string"), spark.createDataFrame([(2, "new")], "k int, v string"), ["k"])
    assert sorted(map(tuple, up.collect())) == [(1, "old"), (2, "new")]


def test_fuzzy_margin(spark):
    scored = spark.createDataFrame([("a", "x", 0.95), ("a", "y", 0.93), ("b", "x", 0.9), ("b", "y", 0.7)], "name string, candidate string, score double")
    assert [(r.name, r.candidate) for r in identity.best_with_margin(scored).collect()] == [("b", "x")]
    names = spark.createDataFrame([("manchester united", "E")], "name string, block string")
    reg = spark.createDataFrame([("united manchester", "E"), ("arsenal", "E")], "name string, block string")
    assert identity.fuzzy_candidates(names, reg).first().score == 1.0


def test_nested_purge_is_strict(spark):
    rows = [(y, date(y, 1, 1)) for y in (2018, 2019, 2020, 2021)] + [(2020, date(2021, 1, 1)), (2019, date(2020, 1, 1))]
    f = evaluation.nested_roles(spark.createDataFrame(rows, "y int, d date"), [2021], "y", "d")
    assert {(r.role, str(r.d)) for r in f.collect()} == {("test", "2021-01-01"), ("calibration", "2020-01-01"), ("tune", "2019-01-01"), ("train", "2018-01-01")}


def test_ece_bins_differ_in_closedness(spark):
    row = spark.range(1).select(evaluation.bin_left(F.lit(0.5), 2).alias("l"), evaluation.bin_right(F.lit(0.5), 2).alias("r"), evaluation.bin_left(F.lit(1.0), 2).alias("t"), evaluation.bin_right(F.lit(0.0), 2).alias("z")).first()
    assert (row.l, row.r, row.t, row.z) == (1, 0, 1, 0)


def test_elo_predicts_before_update(spark):
    rows = [("L", 1, date(2024, 1, 1), 1, 2, 1, 0), ("L", 2, date(2024, 1, 2), 1, 2, None, None), ("L", 3, date(2024, 1, 3), 2, 1, 0, 0)]
    df = spark.createDataFrame(rows, "league string, match_id long, match_date date, home int, away int, hg int, ag int")
    out = {r.match_id: r for r in state.elo(df, advantage=0.0).collect()}
    assert (out[1].home_elo_pre, out[2].home_elo_pre, out[2].away_elo_pre) == (1500, 1510, 1490) and out[3].home_elo_pre == 1490
    score = {r.match_id: r.prior_matches for r in state.scoreline(df).collect()}
    assert score == {1: 0, 2: 1, 3: 1}


def test_replay_excludes_inplay_and_future(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [(1, "h", t(0), 1, 2.0, False), (1, "a", t(1), 2, 3.0, None), (1, "h", t(2), 3, 1.5, True), (1, "h", t(3), 4, 1.4, None), (1, "h", t(4), 5, 2.2, False), (1, "h", t(5), 6, 0.9, False)]
    s = spark.createDataFrame(rows, "market int, runner string, ts timestamp_ntz, pos int, price double, in_play boolean")
    assert {(r.runner, r.price) for r in replay.last_preplay(s).collect()} == {("h", 2.2), ("a", 3.0)}
    cut = spark.createDataFrame([(1, t(0)), (1, t(1)), (1, t(2))], "market int, cutoff timestamp_ntz")
    got = {(r.cutoff.minute, r.runner): (r.price, r.age_s) for r in replay.cutoff_panel(s, cut, 2).collect()}
    assert got == {(1, "h"): (2.0, 60.0), (1, "a"): (3.0, 0.0), (2, "h"): (1.5, 0.0), (2, "a"): (3.0, 60.0)}


def test_contracts():
    assert contracts.classify("B365CH").timing == "closing" and contracts.classify("AvgAHH").market == "asian_handicap"
    assert contracts.odds_pairs(["B365H", "B365CH", "AvgH"]) == {"B365H": "B365CH"}
    with pytest.raises(ValueError):
        contracts.assert_no_closing(["AvgH", "AvgCH"])


def test_memory(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "id long, v array<double>")
    m = spark.createDataFrame([(1, [1.0, 0.1], 2.0), (2, [0.0, 1.0], 10.0)], "id long, v array<double>, value double")
    assert models.memory_values(q, m, 1).first().memory_value == 2.0
    assert 2.0 < models.memory_values(q, m, 2, beta=1.0).first().memory_value < 6.0
    assert models.memory_values(q, m.limit(0), 2).first().memory_value is None


def test_sources(spark, tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    (d / "a.csv").write_bytes("﻿Date,Home,Unnamed: 2\n1,x,\n2\n3,y,z,extra\n".encode())
    (d / "b.csv").write_bytes("Date,Stadt\n1,M\xfcnchen\n".encode("latin1"))
    rows = readers.csv_resilient(spark, str(d)).collect()
    assert len(rows) == 4 and sum(r.malformed for r in rows) == 2 and {tuple(sorted(r.fields)) for r in rows} == {("Date", "Home"), ("Date", "Stadt")}
    assert any(r.fields.get("Stadt") == "München" for r in rows)
    j = tmp_path / "s.json.bz2"
    j.write_bytes(bz2.compress(b"\n".join(json.dumps({"pt": i}).encode() for i in range(3))))
    assert readers.json_lines(spark, str(j), "pt long").agg(F.sum("pt")).first()[0] == 3
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x.csv", "a,b\n1,2\n")
    assert [r.line for r in readers.zip_csv(spark, str(tmp_path / "z.zip")).orderBy("line_no").collect()] == ["a,b", "1,2"]
    con = sqlite3.connect(tmp_path / "q.db")
    con.execute("create table t (a int, b text)")
    con.execute("insert into t values (1, 'x')")
    con.commit()
    con.close()
    assert {(r.column, r.n_rows) for r in readers.sqlite_inventory(spark, str(tmp_path / "q.db")).collect()} == {("a", 1), ("b", 1)}
    assert readers.file_inventory(spark, str(d)).count() == 2


def test_nested_odds_and_series(spark):
    e = [{"id": "1", "home_team": "A", "away_team": "B", "bookmakers": [{"key": "bk", "markets": [{"key": "spreads", "outcomes": [{"name": "B", "price": 1.9, "point": 0.5}, {"name": "A", "price": 2.0, "point": -0.5}]}, {"key": "spreads", "outcomes": [{"name": "A", "price": 2.0, "point": 0.0}]}]}]}]
    out = readers.spread_outcomes(spark.createDataFrame([(json.dumps(e),)], "j string"), "j").collect()
    assert [(r.home_line, r.away_line) for r in out] == [(-0.5, 0.5)]
    s = spark.createDataFrame([("x", ["d1", "d2"], [1.0])], "k string, day array<string>, v array<double>")
    assert [tuple(r) for r in readers.daily_series(s, "day", ["v"]).collect()] == [("x", "d1", 1.0), ("x", "d2", None)]


def test_ledger_is_idempotent(spark):
    ledger = spark.createDataFrame([("a", -0.5, 2.0, "OPEN", None)], "id string, line double, odds double, status string, profit double")
    new = spark.createDataFrame([("a", -0.5, 2.0, "OPEN", None), ("b", 0.0, 2.25, "OPEN", None)], ledger.schema)
    twice = sinks.append_new(sinks.append_new(ledger, new, "id"), new, "id")
    assert twice.count() == 2
    done = sinks.settle(twice, spark.createDataFrame([("b", 1)], "id string, margin int"), "id")
    assert {(r.id, r.status, r.profit) for r in done.collect()} == {("a", "OPEN", None), ("b", "SETTLED_FULL_WIN", 1.25)}
    assert sinks.performance(done).first().settled == 1
    assert "<td>b</td>" in sinks.html_table(done, "t")


def test_streaming_windows_and_state(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, datetime(2024, 1, 1, 0, 1), 7, "view", 1.0), (2, datetime(2024, 1, 1, 0, 40), 7, "view", 2.0), (2, datetime(2024, 1, 1, 0, 40), 7, "view", 2.0), (3, datetime(2024, 1, 1, 5, 0), 7, "view", 3.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(src)
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").parquet(src)
    q = streaming.tumbling(streaming.deduplicated(stream), late=None).writeStream.outputMode("append").format("memory").queryName("tumble").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.value) for r in spark.table("tumble").collect()] == [(2, 3.0)]
    prices = stream.select(F.col("user_id").alias("market"), F.col("event_type").alias("runner"), "ts", (F.col("value") + 1).alias("price"), F.lit(False).alias("in_play"))
    q = streaming.last_price(prices).writeStream.outputMode("update").format("memory").queryName("prices").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("prices").first().price == 4.0


def test_overlap_counts(spark):
    p = spark.createDataFrame(pd.DataFrame({"k": [1, 2, 2, 3], "s": ["a", "a", "b", "b"]}))
    assert [tuple(r) for r in identity.overlaps(p, "k", "s").collect()] == [("a", "b", 1, 1, 1)]
