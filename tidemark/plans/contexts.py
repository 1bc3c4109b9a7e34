"""Contexts of rows: filters, first valid prices, feature blocks, order of folds, staleness, scaling, buckets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, market
from ..operators import context, evaluation, identity
from .base import FX, fixtures, query, r6, table
from .scalars import NOVIG, SETTLE, odds, settled

_PRICES = "CASE WHEN match_id%3=0 THEN NULL WHEN match_id%5=0 THEN 1.0 ELSE odds_h END AS a, CASE WHEN match_id%4=0 THEN 0.5 ELSE odds_h+0.1 END AS b, CASE WHEN match_id%6<>0 THEN odds_h+0.2 END AS c"


@query(f"WITH {FX}, p AS (SELECT match_id, {_PRICES} FROM fx) SELECT match_id, round(CASE WHEN a>1 THEN a WHEN b>1 THEN b WHEN c>1 THEN c END,6) AS price FROM p")
def first_valid_price(spark, sf):
    p = fixtures(spark, sf).select("match_id", *map(F.expr, _PRICES.split(", ")))
    return p.select("match_id", r6(context.first_valid([F.col("a"), F.col("b"), F.col("c")], lambda x: x > 1)).alias("price"))


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderkey%3<>0 AND o_orderkey%5<>0 AND o_orderkey%7<>0 AND o_totalprice-100000>0")
def required_rows(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    rows = o.select("o_orderkey", F.when(k % 3 == 0, "  ").otherwise("x").alias("name"), F.when(k % 5 != 0, F.lit(1)).alias("n"), F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(1.0).alias("x"), (F.col("o_totalprice") - 100_000).alias("over"))
    return context.required(rows, ["name", "n", "x"], ["over"]).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").cast("long").alias("keys"))


_FILTERS = {"short_price": "odds_h < 3", "minus_line": "ah_line < 0", "recent": "season >= 1996", "odd_unless_third": "CASE WHEN match_id%3<>0 THEN match_id%2=1 END"}


@query(f"WITH {FX} " + " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) AS rows, count_if(coalesce({c}, FALSE)) AS kept, count_if({' AND '.join(f'coalesce({x}, FALSE)' for x in list(_FILTERS.values())[: i + 1])}) AS kept_so_far FROM fx" for i, (n, c) in enumerate(_FILTERS.items())))
def context_filters(spark, sf):
    return context.context_counts(fixtures(spark, sf), {n: F.expr(c) for n, c in _FILTERS.items()})


@query(f"WITH {FX}, b AS (SELECT season, league, avg(hg) AS goals, count(*) AS n FROM fx WHERE season<>1995 GROUP BY 1,2) SELECT fx.league, fx.season, count(*) AS rows, count(b.n) AS covered, round(avg(b.goals),6) AS goals FROM fx LEFT JOIN b ON b.season=fx.season AND b.league=fx.league GROUP BY 1,2")
def feature_block_merge(spark, sf):
    fx = fixtures(spark, sf)
    block = fx.where("season <> 1995").groupBy("season", "league").agg(F.avg("hg").alias("goals"), F.count(F.lit(1)).alias("n"))
    j = context.feature_block(fx, block, ["season", "league"], "form")
    return j.groupBy("league", "season").agg(F.count(F.lit(1)).alias("rows"), F.count_if("has_form").alias("covered"), r6(F.avg("form_goals")).alias("goals"))


@query(
    f"""WITH {FX}, r AS (SELECT league AS fold, CASE WHEN season<1996 THEN 'train' WHEN season<1998+match_id%2 THEN 'tune' ELSE 'test' END AS role, season, match_date FROM fx), e AS (SELECT fold, role, min(season) AS a, max(season) AS b, min(match_date) AS c, max(match_date) AS d FROM r GROUP BY 1,2)
SELECT x.fold, x.role AS earlier, y.role AS later, x.d<y.c AS dates_apart, x.b<y.a AS seasons_apart FROM e x JOIN e y ON x.fold=y.fold AND (x.role, y.role) IN (('train','tune'),('tune','test'))"""
)
def fold_order_checks(spark, sf):
    season = F.col("season")
    role = F.when(season < 1996, "train").when(season < 1998 + F.col("match_id") % 2, "tune").otherwise("test")
    return context.order_checks(fixtures(spark, sf).withColumn("role", role), "league", "role", ["train", "tune", "test"], "match_date", "season")


@query(
    "WITH e AS (SELECT event_type, CASE WHEN event_id%11<>0 THEN (epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))/60000000.0 END AS age FROM events) SELECT event_type, CASE WHEN age IS NULL THEN 'missing' WHEN age<=60 THEN '<= 60' WHEN age<=1440 THEN '(60, 1440]' ELSE '> 1440' END AS segment, count(*) AS rows FROM e GROUP BY 1,2"
)
def staleness_segments(spark, sf):
    e = table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    aged = e.select("event_type", F.when(F.col("event_id") % 11 != 0, (us - before) / 60_000_000).alias("age"))
    return context.staleness(aged, ["event_type"], F.col("age"), [60, 1440])


@query(
    f"""WITH {FX}, x AS (SELECT match_id, season<1997 AS train, CASE WHEN match_id%6<>0 THEN odds_h END AS v FROM fx), d AS (SELECT quantile_cont(CASE WHEN train THEN v END, 0.5) AS m FROM x), f AS (SELECT match_id, train, v IS NULL AS gone, coalesce(v, m) AS v FROM x, d), s AS (SELECT avg(CASE WHEN train THEN v END) AS a, stddev_pop(CASE WHEN train THEN v END) AS b FROM f)
SELECT match_id, round((v-a)/b,6) AS z, gone FROM f, s"""
)
def train_only_scaling(spark, sf):
    x = fixtures(spark, sf).select("match_id", "season", F.when(F.col("match_id") % 6 != 0, F.col("odds_h")).alias("v"))
    return context.standardised(x, ["v"], F.col("season") < 1997).select("match_id", r6("v_z").alias("z"), F.col("v_missing").alias("gone"))


@query(f"WITH {SETTLE} SELECT CASE WHEN ah_line<=-1.5 THEN 'deep' WHEN ah_line<=-0.5 THEN 'minus' WHEN ah_line<0.5 THEN 'level' ELSE 'plus' END AS bucket, count(*) AS bets, round(avg(profit),6) AS roi, round(min(ah_line),6) AS low, round(max(ah_line),6) AS high FROM s GROUP BY 1")
def line_buckets(spark, sf):
    line = F.col("ah_line")
    bucket = F.when(line <= -1.5, "deep").when(line <= -0.5, "minus").when(line < 0.5, "level").otherwise("plus")
    return settled(fixtures(spark, sf)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("bets"), r6(F.avg("profit")).alias("roi"), r6(F.min("ah_line")).alias("low"), r6(F.max("ah_line")).alias("high"))


@query(f"WITH {NOVIG}, u AS (SELECT 'home' AS outcome, ph AS q, hg>ag AS hit FROM p UNION ALL SELECT 'draw', pd, hg=ag FROM p UNION ALL SELECT 'away', pa, hg<ag FROM p) SELECT outcome, least(floor(q*10),9)::BIGINT AS bin, count(*) AS n, round(avg(q),6) AS mean_p, round(avg(hit::INT),6) AS rate FROM u GROUP BY 1,2")
def class_calibration(spark, sf):
    h, d, a = market.novig(odds())
    gap = F.col("hg") - F.col("ag")
    rows = fixtures(spark, sf).select(F.inline(F.array(*[F.struct(F.lit(n).alias("outcome"), q.alias("q"), hit.alias("hit")) for n, q, hit in (("home", h, gap > 0), ("draw", d, gap == 0), ("away", a, gap < 0))])))
    return rows.groupBy("outcome", evaluation.bin_left(F.col("q"), 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("q")).alias("mean_p"), r6(F.avg(F.col("hit").cast("int"))).alias("rate"))


@query(f"WITH {FX} SELECT match_id, CASE match_id%3 WHEN 0 THEN match_date WHEN 1 THEN match_date END AS parsed FROM fx")
def iso_or_day_first(spark, sf):
    d = F.col("match_date")
    raw = F.when(F.col("match_id") % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("match_id") % 3 == 1, F.date_format(d, "dd/MM/yyyy")).otherwise(F.concat(F.date_format(d, "yyyy-"), F.lit("13-41")))
    return fixtures(spark, sf).select("match_id", dates.parse_mixed_date(raw).alias("parsed"))


@query("WITH a AS (SELECT lower(n_name) AS alias, n_regionkey AS id FROM nation WHERE n_nationkey%4<>0) SELECT s_suppkey AS key, a.id AS team_id, CASE WHEN a.id IS NULL THEN 'unmatched' ELSE 'exact_normalised' END AS method FROM supplier JOIN nation n ON n.n_nationkey=s_nationkey LEFT JOIN a ON a.alias=lower(n.n_name)")
def attach_team_ids(spark, sf):
    n = table(spark, sf, "nation")
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("key"), F.upper("n_name").alias("name"))
    registry = n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("alias"), F.col("n_regionkey").alias("team"))
    none = registry.limit(0)
    found = identity.alias_cascade(s, registry, none, "name", F.lower("name"), F.lower("alias"))
    return s.join(found, "name").select("key", F.col("team").alias("team_id"), "method")
