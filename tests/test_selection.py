"""Folds, gates, decisions and controls that raise or leave rows alone."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import identity, joins, selection, windows
from tidemark.sources import sinks
from tidemark.streaming import replay


def test_folds_by_position_and_by_expansion():
    folds = selection.positional_folds([2001, 2000, 2003, 2002, 2004])
    assert [(f["train"], f["tune"], f["calibration"], f["test"]) for f in folds] == [([2000], 2001, 2002, 2003), ([2000, 2001], 2002, 2003, 2004)]
    assert selection.expanding_partition([2000, 2001, 2002], 2002) == {"train": [2000], "calibration": [2001], "test": [2002]}
    assert selection.expanding_partition([2000, 2001, 2002], 2002, 1) == {"train": [2000], "calibration": [], "test": [2002]}
    with pytest.raises(ValueError):
        selection.expanding_partition([2000, 2001], 2000)


def test_contract_hash_ignores_order_and_sees_change():
    good = selection.contract_hash({"a": 1, "b": [2]})
    selection.assert_contract({"b": [2], "a": 1}, good)
    with pytest.raises(ValueError):
        selection.assert_contract({"a": 2, "b": [2]}, good)


def test_gate_needs_a_strictly_lower_log_loss(spark):
    cols = "model_log_loss double, market_log_loss double, model_brier double, market_brier double, model_ece double, market_ece double, model_accuracy double, market_accuracy double"
    rows = [(0.9, 1.0, 0.5, 0.5, 0.01, 0.01, 0.5, 0.5), (1.0, 1.0, 0.5, 0.5, 0.01, 0.01, 0.5, 0.5), (0.9, 1.0, 0.6, 0.5, 0.01, 0.01, 0.5, 0.5), (0.9, 1.0, 0.5, 0.5, 0.05, 0.01, 0.5, 0.5)]
    assert [r.passed for r in selection.predictive_gate(spark.createDataFrame(rows, cols)).collect()] == [True, False, False, False]


def test_decision_stops_at_the_first_failed_gate(spark):
    rows = [(0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0.0), (100, 10.0, 0.1, 2.0, 5, 3.0, 4.0, 7.0, 2.0), (100, 10.0, 0.1, 2.0, 5, 6.0, 4.0, 4.0, 2.0), (100, 10.0, 0.1, 2.0, 5, 3.0, 4.0, 7.0, 12.0), (100, 10.0, 0.1, 2.0, 3, 3.0, 4.0, 7.0, 2.0)]
    df = spark.createDataFrame(rows, "b int, p double, r double, z double, y int, by double, bl double, w double, c double")
    got = [r.d for r in df.select(selection.decision(*[F.col(c) for c in df.columns]).alias("d")).collect()]
    assert got == ["predictive_only_no_value", "forward_paper_candidate", "research_only", "research_only", "predictive_only_no_value"]


def test_decisions_must_meet_one_alias(spark):
    aliases = spark.createDataFrame([(1, "A", 7, "candidate", False), (2, "B", 8, "candidate", False)], "alias_id int, alias_name string, team_id int, alias_status string, approved boolean")
    made = lambda *rows: spark.createDataFrame(list(rows), "alias_id int, alias_name string, team_id int, decision string")
    got = {r.alias_id: (r.alias_status, r.approved) for r in identity.apply_decisions(aliases, made((1, "A", 7, "approved"), (2, "B", 8, "rejected"))).collect()}
    assert got == {1: ("approved_obvious_alias", True), 2: ("rejected", False)}
    for bad in ((1, "A", 9, "approved"), (3, "A", 7, "approved"), (1, "X", 7, "approved")):
        with pytest.raises(identity.DecisionError):
            identity.apply_decisions(aliases, made(bad))


def test_shuffles_keep_values_and_same_size_keeps_sizes(spark):
    df = spark.range(400).select("id", (F.col("id") % 4).alias("k"), F.col("id").cast("double").alias("v"))
    for keys in ([], ["k"]):
        out = selection.shuffled(df, "v", "id", keys, "s").toPandas()
        assert sorted(out.v) == list(map(float, range(400))) and (out.v != out.id).any()
    sizes = spark.createDataFrame([(0, 3), (1, 5)], "k long, n long")
    assert sorted((r.k, r["count"]) for r in selection.same_size(df, sizes, ["k"], "id", "s").groupBy("k").count().collect()) == [(0, 3), (1, 5)]


def test_latest_set_is_strictly_before_and_whole(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "b", 9)], "id int, k string, t int")
    snap = spark.createDataFrame([("a", 3, "x"), ("a", 4, "y"), ("a", 4, "z"), ("a", 5, "w")], "k string, d int, v string")
    got = sorted((r.id, r.d, r.v) for r in joins.latest_set(left, snap, ["k"], "t", "d").collect() if r.d) 
    assert got == [(1, 4, "y"), (1, 4, "z")]


def test_intervals_that_overlap_and_that_do_not(spark):
    left = spark.createDataFrame([(1, "a", datetime(2024, 3, 1)), (2, "a", datetime(2023, 1, 1)), (3, "z", datetime(2024, 3, 1))], "id int, k string, t timestamp")
    iv = spark.createDataFrame([("a", datetime(2024, 1, 1), datetime(2024, 6, 1), "long"), ("a", datetime(2024, 2, 20), datetime(2024, 3, 2), "short"), ("a", datetime(2024, 2, 1), None, "open")], "k string, s timestamp, e timestamp, v string")
    got = {r.id: r.v for r in joins.interval_join(left, iv, ["k"], "t", "s", "e", [F.col("s").desc()]).collect()}
    assert got == {1: "short", 2: None, 3: None}
    apart = spark.createDataFrame([("a", datetime(2022, 1, 1), datetime(2022, 2, 1), "past"), ("a", datetime(2024, 1, 1), None, "now")], iv.schema)
    assert {r.id: r.v for r in joins.current_interval(left, apart, ["k"], "t", "s", "e").collect()} == {1: "now", 2: None, 3: None}


def test_last_means_and_lagged_history_exclude_the_day(spark):
    rows = [("a", i, datetime(2024, 1, d).date(), float(v)) for i, (d, v) in enumerate([(1, 1), (2, 3), (2, 5), (3, 7)])]
    df = spark.createDataFrame(rows, "k string, id int, match_date date, v double")
    got = [r.m.v for r in windows.last_means(df, {"v": F.col("v")}, ["k"], 2, ["id"], "m").orderBy("id").collect()]
    assert got == [None, 1.0, 1.0, 4.0]
    assert [r.history_count for r in windows.lagged_history(df, ["k"], "match_date", ["id"], ["v"], [2]).orderBy("id").collect()] == [1, 2, 3, 4]


def test_markdown_and_slug(spark):
    assert sinks.markdown_table(spark.createDataFrame([(1, "a|b"), (2, None)], "x int, y string")) == "| x | y |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |"
    assert spark.range(1).select(sinks.safe_slug(F.lit(" A&B c! ")).alias("s")).first().s == "a_b_c"


def test_cutoffs_are_emitted_by_timers(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    schema = "market long, runner string, ts timestamp, price double, in_play boolean, market_start timestamp"
    start = at(12, 0)
    first = [(1, "h", at(10, 0), 2.0, False, start), (1, "h", at(11, 0), 2.2, None, start), (1, "a", at(11, 30), 3.0, False, start), (1, "h", at(11, 40), 0.5, False, start), (2, "h", at(9, 0), 5.0, False, start)]
    later = [(1, "h", at(11, 50), 9.0, True, start), (3, "x", at(13, 0), 4.0, False, at(20, 0))]
    src = str(tmp_path / "in")
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = replay.cutoff_prices(stream, ["1 hour", "10 minutes"]).writeStream.outputMode("append").format("memory").queryName("cutoffs").start()
    q.processAllAvailable()
    spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    spark.createDataFrame([(9, "x", at(14, 0), 4.0, False, at(23, 0))], schema).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    got = sorted((r.market, r.cutoff.hour, r.cutoff.minute, r.runner, r.price, r.age_s) for r in spark.table("cutoffs").collect())
    # the update at exactly 11:00 counts; market 2 is silent after 9:00 and still emitted; in-play prices are not
    assert got == [(1, 11, 0, "h", 2.2, 0.0), (1, 11, 50, "a", 3.0, 1200.0), (1, 11, 50, "h", 2.2, 3000.0), (2, 11, 0, "h", 5.0, 7200.0), (2, 11, 50, "h", 5.0, 10200.0)]
