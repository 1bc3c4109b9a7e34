"""Readers, sinks and stores on files made from the tables: what is written is read back by the engine's own readers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, text
from ..operators import contracts, evaluation, identity, selection, windows
from ..operators.ranks import ranked
from ..sources import readers, sinks
from ..sources.cuts import shared_folder
from ..sources.resume import Store
from .base import FX, fixtures, query, r6, sides, table
from .scalars import SETTLE, settled


def _folder(spark, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def _suppliers(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("int").alias("nation"))


_FIELDS = T.StructType([T.StructField("key", T.LongType()), T.StructField("name", T.StringType()), T.StructField("nation", T.IntegerType())])


@query("SELECT s_suppkey::BIGINT AS key, s_name AS name, s_nationkey::INT AS nation FROM supplier")
def csv_strict_rows(spark, sf):
    path = _folder(spark, "strict")
    sinks.write_report(_suppliers(spark, sf).withColumnRenamed("key", "﻿ key "), path)
    return readers.csv_strict(spark, path).select(F.col("key").cast("long").alias("key"), "name", F.col("nation").cast("int").alias("nation"))


@query("SELECT count(*) AS rows, sum(s_suppkey)::BIGINT AS keys, (SELECT count(*) FROM supplier WHERE s_suppkey%7=0) AS skipped FROM supplier WHERE s_suppkey%7<>0")
def csv_flexible_rows(spark, sf):
    path = _folder(spark, "flexible")
    s = _suppliers(spark, sf)
    key = F.when(F.col("key") % 7 == 0, F.concat(F.lit("no"), F.col("key").cast("string"))).otherwise(F.col("key").cast("string"))
    sinks.write_report(s.select(key.alias("key"), "name", "nation"), path)
    rows, skipped = readers.csv_flexible(spark, path, _FIELDS)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("key").alias("keys")).crossJoin(F.broadcast(skipped))  # both are one row


@query("SELECT s_nationkey::INT AS nation, count(*) AS rows, sum(CASE WHEN s_suppkey%5=0 THEN 1 ELSE 0 END)::BIGINT AS malformed, count(CASE WHEN s_suppkey%5<>0 THEN s_name END) AS names FROM supplier GROUP BY 1")
def csv_resilient_rows(spark, sf):
    path = _folder(spark, "ragged")
    s = _suppliers(spark, sf)
    line = F.when(F.col("key") % 5 == 0, F.col("nation").cast("string")).otherwise(F.concat_ws(",", F.col("nation").cast("string"), "name", F.lit("")))
    body = s.groupBy("nation").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("b"))  # a small file a nation
    body.select(F.concat(F.lit("nation, name ,Unnamed: 2\n"), F.col("b")).alias("value"), "nation").repartition("nation").write.partitionBy("nation").text(path)
    r = readers.csv_resilient(spark, path)
    return r.groupBy(F.col("fields")["nation"].cast("int").alias("nation")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("malformed").alias("malformed"), F.count(F.col("fields")["name"]).alias("names"))


@query("SELECT CASE WHEN n_nationkey%3=0 THEN 'utf-8' WHEN n_nationkey%3=1 THEN 'cp1252' ELSE 'utf-8' END AS encoding, 'Ä' || n_name AS name FROM nation")
def csv_encoding_cascade(spark, sf):
    path = _folder(spark, "encodings")
    n = table(spark, sf, "nation").select(F.concat(F.lit("Ä"), "n_name").alias("name"), F.col("n_nationkey").alias("key"))
    for part, encoding in ((0, "UTF-8"), (1, "ISO-8859-1"), (2, "UTF-8")):
        n.where(F.col("key") % 3 == part).select("name").coalesce(1).write.option("header", True).option("encoding", encoding).csv(f"{path}/{part}")
    found = readers.encodings(spark, path).select("encoding", F.regexp_extract("file", r"/(\d)/[^/]*$", 1).alias("part"))
    rows = readers.csv_cascade(spark, path, T.StructType([T.StructField("name", T.StringType())])).withColumn("file", F.input_file_name())
    return rows.withColumn("part", F.regexp_extract("file", r"/(\d)/[^/]*$", 1)).join(F.broadcast(found), "part").select("encoding", "name")  # a row a file


@query("SELECT c_custkey::BIGINT AS key, c_name AS name, round(c_acctbal,2) AS balance FROM customer")
def json_lines_bz2(spark, sf):
    path = _folder(spark, "lines")
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("key"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("balance"))
    c.write.option("compression", "bzip2").json(path)
    return readers.json_lines(spark, path, "key long, name string, balance double")


@query("SELECT n_regionkey AS region, 'txt' AS extension, length(b)+1 AS bytes, sha256(b || chr(10)) AS sha256 FROM (SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS b FROM nation GROUP BY 1)")
def file_fingerprints(spark, sf):
    path = _folder(spark, "archive")
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ";").alias("value"))
    n.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    f = readers.file_inventory(spark, path).where(F.col("file").contains("part-"))
    return f.select(F.regexp_extract("file", r"n_regionkey=(\d+)/", 1).cast("long").alias("region"), "extension", "bytes", "sha256")


@query("SELECT o_custkey AS cust, o_orderdate AS date, round(o_totalprice,2) AS price, CASE WHEN o_orderkey%4<>0 THEN o_orderpriority END AS priority FROM orders")
def columnar_series(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.struct("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority").alias("r"))
    one = o.groupBy(F.col("o_custkey").alias("cust")).agg(F.sort_array(F.collect_list("r")).alias("r"))
    priority = F.transform("r", lambda r: F.when(r["o_orderkey"] % 4 != 0, r["o_orderpriority"]))
    cols = one.select("cust", F.transform("r", lambda r: r["o_orderdate"]).alias("date"), F.transform("r", lambda r: F.round(r["o_totalprice"], 2)).alias("price"), priority.alias("priority"))
    return readers.daily_series(cols, "date", ["price", "priority"])


@query(f"WITH {FX} SELECT CAST(match_id AS VARCHAR) AS id, CASE WHEN match_id%2=0 THEN 'alpha' ELSE 'beta' END AS bookmaker, CAST(home AS VARCHAR) AS home_team, CAST(away AS VARCHAR) AS away_team, ah_line AS home_line, round(odds_h,6) AS home_odds, -ah_line AS away_line, round(odds_a,6) AS away_odds FROM fx WHERE match_id%5<>0")
def nested_spread_odds(spark, sf):
    fx = fixtures(spark, sf)
    side = lambda team, odds, line: F.struct(F.col(team).cast("string").alias("name"), F.col(odds).alias("price"), line.alias("point"))
    both = F.array(side("away", "odds_a", -F.col("ah_line")), side("home", "odds_h", F.col("ah_line")))
    outcomes = F.when(F.col("match_id") % 5 == 0, F.slice(both, 1, 1)).otherwise(both)  # a side is missing
    markets = F.array(F.struct(F.lit("h2h").alias("key"), both.alias("outcomes")), F.struct(F.lit("spreads").alias("key"), outcomes.alias("outcomes")))
    book = F.array(F.struct(F.when(F.col("match_id") % 2 == 0, "alpha").otherwise("beta").alias("key"), markets.alias("markets")))
    event = F.struct(F.col("match_id").cast("string").alias("id"), F.col("home").cast("string").alias("home_team"), F.col("away").cast("string").alias("away_team"), book.alias("bookmakers"))
    out = readers.spread_outcomes(fx.select(F.to_json(F.array(event)).alias("payload")), "payload")
    return out.withColumns({c: r6(c) for c in ("home_odds", "away_odds")})


@query("SELECT o_orderkey AS key, max(o_orderstatus) AS status, count(*) AS n FROM orders GROUP BY 1")
def resume_store(spark, sf):
    """Two batches into a store, the second with rows of the first, and the second once more, as after a crash."""
    store = Store(spark, _folder(spark, "store"), "key long, status string, n long", ["key"])
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("key"), F.col("o_orderstatus").alias("status"), F.lit(1).cast("long").alias("n"))
    run = store.batches(lambda rows: rows)
    run(o.where("key % 3 <> 0").withColumn("status", F.lit("failed")), 0)
    run(o.where("key % 3 = 0").unionByName(store.pending(o, F.col("stored.status") == "failed").where("key % 3 <> 0")), 1)
    run(o.withColumn("status", F.lit("again")), 1)
    return store.rows()


@query(f"WITH {FX} SELECT 'file' AS league, season, count(*) AS n FROM (SELECT CASE WHEN match_id%3=2 AND season<1950 THEN NULL ELSE season END AS season FROM fx) GROUP BY 2")
def seasons_of_paths(spark, sf):
    fx, s = fixtures(spark, sf), F.col("season")
    two = lambda x: F.lpad((x % 100).cast("string"), 2, "0")
    name = F.when(F.col("match_id") % 3 == 0, F.concat(s.cast("string"), F.lit("-"), (s + 1).cast("string"))).when(F.col("match_id") % 3 == 1, F.concat(s.cast("string"), F.lit("_"), two(s + 1))).otherwise(F.concat(two(s), two(s + 1)))
    path = F.concat(F.lit("/data/file/E0_"), name, F.lit(".csv"))
    return fx.groupBy(F.split(path, "/")[2].alias("league"), dates.season_from_path(path).alias("season")).agg(F.count(F.lit(1)).alias("n"))


_PLAIN = "regexp_replace(trim(regexp_replace(replace(replace(lower(p_name || ' Éa & ' || p_brand), 'é', 'e'), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' +', ' ', 'g')"


@query(f"SELECT p_partkey, array_to_string(list_sort(string_split({_PLAIN}, ' ')), ' ') AS sorted, {_PLAIN} AS player FROM part")
def player_names(spark, sf):
    name = F.concat("p_name", F.lit(" Éa & "), "p_brand")
    return table(spark, sf, "part").select("p_partkey", text.token_sort(name).alias("sorted"), text.name_player(name).alias("player"))


@query(
    f"""WITH {FX}, c AS (SELECT league || season AS name, home AS candidate, round(0.7+avg(hg)/8,6) AS score FROM fx GROUP BY league, season, home), r AS (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY name ORDER BY score DESC, candidate))
SELECT name, candidate, score, second FROM r WHERE rn=1 AND score>=0.8 AND round(score-coalesce(second,0),9)>=0.01"""
)
def margin_gated_match(spark, sf):
    c = fixtures(spark, sf).groupBy(F.concat("league", "season").alias("name"), F.col("home").alias("candidate")).agg(F.round(0.7 + F.avg("hg") / 8, 6).alias("score"))
    return identity.best_with_margin(c, 0.8, 0.01 - 1e-10)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def epoch_to_iso(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", dates.iso_utc(dates.from_millis(ms)).alias("iso"))


@query("SELECT count(*) AS rows, 'part' AS source, '{\"p_brand\": \"string\", \"p_partkey\": \"bigint\"}' AS columns, length(sha) AS hash_digits FROM part, (SELECT sha256('x') AS sha) GROUP BY sha")
def manifest_contract(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand")
    made = json.loads(sinks.manifest(p, source="part"))
    digest = selection.contract_hash(made)
    selection.assert_contract(json.loads(json.dumps(made)), digest)
    return p.agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") == made["rows"]).select("rows", F.lit(made["source"]).alias("source"), F.lit(json.dumps(made["columns"], sort_keys=True)).alias("columns"), F.lit(len(digest)).cast("long").alias("hash_digits"))


@query(f"WITH {FX} SELECT season, count(*) AS matches, " + ", ".join(f"round(avg({c}),6) AS mean_{c}" for c in ("odds_h", "odds_d", "odds_a")) + " FROM fx GROUP BY 1")
def feature_group_means(spark, sf):
    """The price columns, found by pattern, with the closing ones refused."""
    fx = fixtures(spark, sf).withColumn("odds_closing", F.col("odds_h"))
    group = contracts.feature_group(fx.columns, ["^odds_"], [r"closing"])
    contracts.assert_no_closing(group)
    return fx.groupBy("season").agg(F.count(F.lit(1)).alias("matches"), *[r6(F.avg(c)).alias(f"mean_{c}") for c in group])


@query(
    f"""WITH {SETTLE}, r AS (SELECT * FROM (VALUES (1, 1.5, 2.0, -0.5, 0.0), (2, 2.0, 3.0, 0.0, 0.1), (3, 1.2, 9.0, 0.05, 9.0)) AS t(rule_id, o1, o2, e1, e2)), j AS (SELECT rule_id, profit FROM s JOIN r ON odds_h>=o1 AND odds_h<o2 AND odds_h-odds_a>=e1 AND odds_h-odds_a<e2)
SELECT rule_id, count(*) AS bets, round(sum(profit),6) AS profit FROM j GROUP BY 1"""
)
def banded_rules(spark, sf):
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("rule_id", "o1", "o2", "e1", "e2"), r)]) for r in ((1, 1.5, 2.0, -0.5, 0.0), (2, 2.0, 3.0, 0.0, 0.1), (3, 1.2, 9.0, 0.05, 9.0))])))
    gap = F.col("odds_h") - F.col("odds_a")
    met = (F.col("odds_h") >= F.col("o1")) & (F.col("odds_h") < F.col("o2")) & (gap >= F.col("e1")) & (gap < F.col("e2"))
    return evaluation.rule_grid(settled(fixtures(spark, sf)), rules, met).select("rule_id", "bets", r6("profit").alias("profit"))


@query(f"WITH {FX}, t AS (" + " UNION ALL ".join(f"SELECT season+1 AS season, {q}::DOUBLE AS q, quantile_cont(odds_a, {q}) AS cut FROM fx GROUP BY 1" for q in (0.5, 0.6, 0.7, 0.8)) + ") SELECT season, q, round(any_value(cut),6) AS cut, count(*) AS picks FROM fx JOIN t USING (season) WHERE odds_a>=cut GROUP BY 1,2")
def thresholds_from_prior_season(spark, sf):
    """Every quantile of the search, from one aggregation a season."""
    fx, qs = fixtures(spark, sf), [0.5, 0.6, 0.7, 0.8]
    cuts = fx.groupBy((F.col("season") + 1).alias("season")).agg(F.percentile("odds_a", F.array(*map(F.lit, qs))).alias("c")).select("season", F.inline(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("c").alias("cut"))))
    return fx.join(cuts, "season").where("odds_a >= cut").groupBy("season", "q").agg(r6(F.first("cut")).alias("cut"), F.count(F.lit(1)).alias("picks"))


@query(f"WITH {FX}, s AS (SELECT league, match_date, match_id, home AS team FROM fx UNION ALL SELECT league, match_date, match_id, away FROM fx) SELECT match_id, team, count(*) OVER (PARTITION BY league, team ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS played FROM s")
def matches_played_before(spark, sf):
    s = sides(fixtures(spark, sf))
    return s.select("match_id", "team", F.count(F.lit(1)).over(windows.before_date(["league", "team"])).alias("played"))


@query(f"WITH {FX}, r AS (SELECT match_id, odds_h, row_number() OVER (ORDER BY odds_h, match_id) AS a, count(*) OVER () AS n FROM fx) SELECT match_id, round(odds_h,6) AS odds_h, a AS place FROM r WHERE a<=5 OR a>n-5")
def head_and_tail(spark, sf):
    r = ranked(fixtures(spark, sf).select("match_id", "odds_h"), ["odds_h", "match_id"], name="place", total="n")
    return r.where((F.col("place") <= 5) | (F.col("place") > F.col("n") - 5)).select("match_id", r6("odds_h").alias("odds_h"), "place")
