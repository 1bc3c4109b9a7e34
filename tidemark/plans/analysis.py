"""Identity, aggregation, evaluation and selection queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import market, text
from ..operators import evaluation as ev
from ..operators import identity, windows
from ..operators.ranks import ranked
from .base import FX, fixtures, query, r6, sides, table
from .scalars import NOVIG, SETTLE, odds, settled


def _bets(spark, sf):
    return settled(fixtures(spark, sf))


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1,2 HAVING count(*)>1")
def dedup_flags(spark, sf):
    dup = identity.flag_duplicates(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])
    return dup.where("is_duplicate").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey % 3, l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice,2) AS price FROM r WHERE rn=1"""
)
def dedup_priority(spark, sf):
    order = [F.col("l_suppkey") % 3, F.col("l_shipdate").desc(), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")]
    kept = identity.keep_one(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"), ["l_orderkey", "l_linenumber"], order)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).alias("price"))


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey%3 AS pr, min(l_suppkey%3) OVER (PARTITION BY l_orderkey, l_linenumber) AS top, l_returnflag || l_linestatus AS v FROM lineitem),
g AS (SELECT l_orderkey, l_linenumber, count(*) AS n_rows, count(DISTINCT v) AS n_variants, count(DISTINCT CASE WHEN pr=top THEN v END) AS t FROM t GROUP BY 1,2)
SELECT CASE WHEN n_variants<=1 THEN 'none' WHEN t<=1 THEN 'resolved_by_source_priority' ELSE 'quarantined' END AS status, count(*) AS n, sum(n_rows)::BIGINT AS n_rows FROM g GROUP BY 1"""
)
def dedup_conflict_status(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("pr", F.col("l_suppkey") % 3)  # noqa: E741
    g = identity.conflict_status(l, ["l_orderkey", "l_linenumber"], "pr", ["l_returnflag", "l_linestatus"])
    return g.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("n_rows"))


@query(
    f"WITH {FX} SELECT match_id, substr(league,1,1) || season || lpad(CAST(row_number() OVER (PARTITION BY league, season ORDER BY match_date, match_id) AS VARCHAR),5,'0') AS seq_id FROM fx"
)
def sequence_ids(spark, sf):
    prefix = F.concat(F.substring("league", 1, 1), F.col("season").cast("string"))
    return identity.sequence_ids(fixtures(spark, sf), ["league", "season"], ["match_date", "match_id"], prefix, 5).select("match_id", "seq_id")


@query(
    f"WITH {FX}, k AS (SELECT match_id, league || '|' || match_date || '|' || home || '|' || away AS k FROM fx) SELECT match_id, 'ah_' || substr(sha256(k),1,24) AS paper_id, ('0x' || substr(sha256(k),1,15))::BIGINT AS hashed FROM k"
)
def sha_match_id(spark, sf):
    parts = [F.col(c).cast("string") for c in ("league", "match_date", "home", "away")]
    return fixtures(spark, sf).select("match_id", text.paper_id("ah_", *parts).alias("paper_id"), text.hashed_id(*parts).alias("hashed"))


@query(
    "SELECT o_orderkey AS k, round(CASE WHEN o_orderkey%3=0 THEN o_totalprice*2 ELSE o_totalprice END,2) AS v, o_orderkey%3=0 AS updated FROM orders WHERE o_orderkey%2=0 OR o_orderkey%3=0"
)
def upsert_keep_last(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    old, new = o.where("k % 2 = 0").withColumn("updated", F.lit(False)), o.where("k % 3 = 0").select("k", (F.col("v") * 2).alias("v"), F.lit(True).alias("updated"))
    return identity.upsert(old, new, ["k"]).select("k", F.round("v", 2).alias("v"), "updated")


PICKS = f"""{FX}, picks AS (SELECT match_id, 'home' AS strategy FROM fx WHERE odds_h<2.2 UNION ALL SELECT match_id, 'draw' FROM fx WHERE odds_d<3.2 UNION ALL SELECT match_id, 'away' FROM fx WHERE odds_a<2.5)"""


def _picks(spark, sf):
    rules = F.array(F.when(F.col("odds_h") < 2.2, "home"), F.when(F.col("odds_d") < 3.2, "draw"), F.when(F.col("odds_a") < 2.5, "away"))
    return fixtures(spark, sf).select("match_id", F.explode(F.array_compact(rules)).alias("strategy"))


@query(
    f"""WITH {PICKS}, s AS (SELECT strategy, count(*) AS n FROM picks GROUP BY 1), j AS (SELECT x.strategy AS a, y.strategy AS b, count(*) AS n FROM picks x JOIN picks y USING (match_id) WHERE x.strategy<y.strategy GROUP BY 1,2)
SELECT a.strategy AS a, b.strategy AS b, coalesce(j.n,0) AS n_both, a.n-coalesce(j.n,0) AS only_a, b.n-coalesce(j.n,0) AS only_b FROM s a JOIN s b ON a.strategy<b.strategy LEFT JOIN j ON j.a=a.strategy AND j.b=b.strategy"""
)
def strategy_overlap(spark, sf):
    return identity.overlaps(_picks(spark, sf), "match_id", "strategy")


@query(f"WITH {PICKS} SELECT match_id, count(DISTINCT strategy) AS n_strategies FROM picks GROUP BY 1 HAVING count(DISTINCT strategy)>=2")
def intersection_k(spark, sf):
    return identity.combine(_picks(spark, sf), ["match_id"], "strategy", 2)


@query(f"WITH {FX}, r AS (SELECT match_id, league, season, row_number() OVER (PARTITION BY league, season ORDER BY match_id) AS rn FROM fx) SELECT match_id, league, season FROM r ORDER BY rn, league, season, match_id LIMIT 50")
def stratified_sample(spark, sf):
    return identity.round_robin_sample(fixtures(spark, sf).select("match_id", "league", "season"), ["league", "season"], ["match_id"], 50)


@query("SELECT c_mktsegment || (c_nationkey%5) AS alias, count(DISTINCT c_nationkey) AS n_teams, string_agg(DISTINCT CAST(c_nationkey AS VARCHAR), '; ' ORDER BY CAST(c_nationkey AS VARCHAR)) AS teams FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey)>1")
def alias_conflicts(spark, sf):
    c = table(spark, sf, "customer").select(F.concat("c_mktsegment", (F.col("c_nationkey") % 5).cast("string")).alias("alias"), "c_nationkey")
    return identity.alias_conflicts(c, "alias", "c_nationkey")


@query(
    """WITH k AS (SELECT n_name AS name, n_nationkey+1 AS id FROM nation WHERE n_nationkey<15), m AS (SELECT n_name AS name FROM nation WHERE n_nationkey>=15)
SELECT name, id::BIGINT AS id FROM k UNION ALL SELECT name, (SELECT max(id) FROM k) + row_number() OVER (ORDER BY name) FROM m"""
)
def surrogate_ids(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 1).alias("id"))
    return identity.surrogate_ids(n.where("id <= 15"), n.select("name"), "name", "id")


@query(
    """SELECT p_partkey || p_brand AS name, CASE WHEN p_partkey%4=0 THEN lower(p_brand) WHEN p_partkey%4=1 THEN 'curated' END AS team, CASE WHEN p_partkey%4=0 THEN 'exact_normalised' WHEN p_partkey%4=1 THEN 'curated' ELSE 'unmatched' END AS method FROM part"""
)
def alias_cascade(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), "p_brand").alias("name"), "p_partkey", "p_brand")
    registry = p.where("p_partkey % 4 = 0").select(F.upper("name").alias("reg"), F.lower("p_brand").alias("team"))
    curated = p.where("p_partkey % 4 = 1").select(F.col("name").alias("alias"), F.lit("curated").alias("team"))
    return identity.alias_cascade(p, registry, curated, "name", text.name_compact(F.col("name")), text.name_compact(F.col("reg")))


def _fall(version: int) -> str:
    peak = "greatest(0, max(cum) OVER w)" if version == 3 else "max(cum) OVER w"
    sign = "-" if version == 2 else ""
    return f"""WITH {SETTLE}, c AS (SELECT *, sum(profit) OVER (PARTITION BY league ORDER BY match_date, match_id) AS cum FROM s), d AS (SELECT league, {peak} - cum AS fall FROM c WINDOW w AS (PARTITION BY league ORDER BY match_date, match_id))
SELECT league, round({sign}max(fall),6) AS max_drawdown FROM d GROUP BY 1"""


def _drawdown(spark, sf, version):
    return windows.drawdown(_bets(spark, sf), ["league"], ["match_date", "match_id"], "profit", version).select("league", r6("max_drawdown").alias("max_drawdown"))


@query(_fall(1))
def drawdown_v1(spark, sf):
    return _drawdown(spark, sf, 1)


@query(_fall(2))
def drawdown_v2(spark, sf):
    return _drawdown(spark, sf, 2)


@query(_fall(3))
def drawdown_v3(spark, sf):
    return _drawdown(spark, sf, 3)


@query(
    f"""WITH {SETTLE}, r AS (SELECT league, profit<0 AS l, row_number() OVER w - sum(CASE WHEN profit<0 THEN 1 ELSE 0 END) OVER w AS i FROM s WINDOW w AS (PARTITION BY league ORDER BY match_date, match_id))
SELECT league, max(n)::BIGINT AS longest_losing_streak FROM (SELECT league, i, count(*) AS n FROM r WHERE l GROUP BY 1,2) GROUP BY 1"""
)
def losing_streak(spark, sf):
    return windows.losing_streak(_bets(spark, sf), ["league"], ["match_date", "match_id"], "profit")


@query(f"WITH {FX}, g AS (SELECT season, league, sum(odds_h) AS v FROM fx GROUP BY 1,2), s AS (SELECT season, v/sum(v) OVER (PARTITION BY season) AS s FROM g) SELECT season, round(sum(s*s),6) AS hhi, round(max(s),6) AS top_share FROM s GROUP BY 1")
def hhi_concentration(spark, sf):
    return ev.concentration(fixtures(spark, sf), ["season"], "league", "odds_h").select("season", r6("hhi").alias("hhi"), r6("top_share").alias("top_share"))


@query(
    f"""WITH {SETTLE} SELECT league, season, month(match_date)::INT AS month, count(*) AS bets, round(sum(profit),6) AS profit FROM s GROUP BY GROUPING SETS ((league),(season),(month(match_date)),())"""
)
def grouping_sets_summary(spark, sf):
    bets = _bets(spark, sf).withColumn("month", F.month("match_date"))
    g = bets.groupingSets([[F.col("league")], [F.col("season")], [F.col("month")], []], "league", "season", "month")
    return g.agg(F.count(F.lit(1)).alias("bets"), r6(F.sum("profit")).alias("profit"))


@query(
    "SELECT user_id, min(CASE WHEN event_type='view' THEN value END) AS view, min(CASE WHEN event_type='click' THEN value END) AS click, min(CASE WHEN event_type='purchase' THEN value END) AS purchase FROM events WHERE event_type IN ('view','click','purchase') GROUP BY 1"
)
def pivot_cutoffs(spark, sf):
    kinds = ["view", "click", "purchase"]
    return table(spark, sf, "events").where(F.col("event_type").isin(kinds)).groupBy("user_id").pivot("event_type", kinds).agg(F.min("value"))


@query(
    """WITH r AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS rn FROM lineitem)
SELECT l_suppkey, round(sum(CASE WHEN rn<=5 THEN v END),2) AS top5, round(sum(CASE WHEN rn<=11 THEN v END),2) AS top11, count(*) AS depth, round(sum(CASE WHEN rn<=5 THEN v END)/sum(v),6) AS top5_share FROM r GROUP BY 1"""
)
def topk_sums(spark, sf):
    r = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("v")).withColumn("rn", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("v"))))
    top = lambda k: F.sum(F.when(F.col("rn") <= k, F.col("v")))
    return r.groupBy("l_suppkey").agg(F.round(top(5), 2).alias("top5"), F.round(top(11), 2).alias("top11"), F.count(F.lit(1)).alias("depth"), r6(top(5) / F.sum("v")).alias("top5_share"))


@query(
    f"""WITH {FX}, w AS (SELECT match_id, 1/sqrt(count(*) OVER (PARTITION BY league)) * pow(0.5, date_diff('day', match_date, max(match_date) OVER ())/365.0) AS w FROM fx) SELECT match_id, round(w/avg(w) OVER (),6) AS weight FROM w"""
)
def recency_weights(spark, sf):
    fx = fixtures(spark, sf).select("match_id", "league", "match_date")
    counts = fx.groupBy("league").agg(F.count(F.lit(1)).alias("n"))
    last = fx.agg(F.max("match_date").alias("last"))
    w = fx.join(counts, "league").crossJoin(F.broadcast(last)).select("match_id", (1 / F.sqrt("n") * F.pow(F.lit(0.5), F.date_diff("last", "match_date") / 365.0)).alias("w"))  # last is one row
    return w.crossJoin(F.broadcast(w.agg(F.avg("w").alias("m")))).select("match_id", r6(F.col("w") / F.col("m")).alias("weight"))


@query(
    """SELECT 'value' AS feature, count(*) AS n_rows, count(value) AS filled, count(DISTINCT value) AS n_distinct FROM events UNION ALL SELECT 'event_type', count(*), count(event_type), count(DISTINCT event_type) FROM events UNION ALL SELECT 'user_id', count(*), count(user_id), count(DISTINCT user_id) FROM events"""
)
def coverage_profile(spark, sf):
    cols = ["value", "event_type", "user_id"]
    one = table(spark, sf, "events").agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"f_{c}") for c in cols], *[F.count_distinct(c).alias(f"d_{c}") for c in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col("n").alias("n_rows"), F.col(f"f_{c}").alias("filled"), F.col(f"d_{c}").alias("n_distinct")) for c in cols])))


@query(
    f"WITH {FX} SELECT league, round(quantile_cont(odds_h,0.25),6) AS q25, round(quantile_cont(odds_h,0.5),6) AS q50, round(quantile_cont(odds_h,0.9),6) AS q90, round(corr(odds_h, odds_a),6) AS corr, round(stddev_samp(odds_h),6) AS sd FROM fx GROUP BY 1"
)
def quantile_summary(spark, sf):
    q = lambda p: r6(F.percentile("odds_h", F.lit(p)))
    return fixtures(spark, sf).groupBy("league").agg(q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.9).alias("q90"), r6(F.corr("odds_h", "odds_a")).alias("corr"), r6(F.stddev_samp("odds_h")).alias("sd"))


Y = "CASE WHEN hg>ag THEN 0 WHEN hg=ag THEN 1 ELSE 2 END"


def _scored(spark, sf):
    h, d, a = market.novig(odds())
    return fixtures(spark, sf).select("*", h.alias("ph"), d.alias("pd"), a.alias("pa"), F.expr(Y).alias("y"))


@query(
    f"""WITH {NOVIG}, y AS (SELECT *, {Y} AS y FROM p) SELECT league, round(avg(-ln(CASE y WHEN 0 THEN ph WHEN 1 THEN pd ELSE pa END)),6) AS logloss, round(avg(pow(ph-(y=0)::INT,2)+pow(pd-(y=1)::INT,2)+pow(pa-(y=2)::INT,2)),6) AS brier_sum,
round(avg((pow(ph-(y=0)::INT,2)+pow(pd-(y=1)::INT,2)+pow(pa-(y=2)::INT,2))/3),6) AS brier_mean, round(avg(-ln(CASE WHEN y=0 THEN ph ELSE 1-ph END)),6) AS home_logloss, round(avg(pow(ph-(y=0)::INT,2)),6) AS home_brier FROM y GROUP BY 1"""
)
def logloss_brier(spark, sf):
    ps, y = [F.col("ph"), F.col("pd"), F.col("pa")], F.col("y")
    home = (y == 0).cast("int")
    return _scored(spark, sf).groupBy("league").agg(
        r6(ev.multiclass_log_loss(ps, y)).alias("logloss"), r6(ev.multiclass_brier(ps, y)).alias("brier_sum"), r6(ev.multiclass_brier(ps, y, True)).alias("brier_mean"), r6(ev.log_loss(ps[0], home)).alias("home_logloss"), r6(ev.brier(ps[0], home)).alias("home_brier")
    )


def _ece_sql(conf: str, hit: str, bins: str) -> str:
    return f"WITH {NOVIG}, y AS (SELECT *, {Y} AS y FROM p), c AS (SELECT league, {conf} AS c, {hit} AS h FROM y), b AS (SELECT league, {bins} AS b, count(*) AS n, avg(c) AS c, avg(h) AS a FROM c GROUP BY 1,2) SELECT league, round(sum(n*abs(c-a))/sum(n),6) AS ece FROM b GROUP BY 1"


TOP, HIT = "greatest(ph,pd,pa)", "(CASE WHEN ph>=pd AND ph>=pa THEN 0 WHEN pd>=pa THEN 1 ELSE 2 END = y)::INT"


def _ece(spark, sf, conf, hit, bins):
    s = _scored(spark, sf).select("league", conf.alias("c"), hit.cast("int").alias("h"))
    return ev.calibration_error(s, ["league"], F.col("c"), F.col("h"), bins(F.col("c"))).select("league", r6("ece").alias("ece"))




def _top():
    return F.greatest("ph", "pd", "pa"), F.expr("CASE WHEN ph>=pd AND ph>=pa THEN 0 WHEN pd>=pa THEN 1 ELSE 2 END = y")


@query(_ece_sql("ph", "(y=0)::INT", "least(floor(c*10),9)"))
def ece_10bin(spark, sf):
    return _ece(spark, sf, F.col("ph"), F.col("y") == 0, lambda c: ev.bin_left(c, 10))


@query(_ece_sql(TOP, HIT, "least(floor(c*15),14)"))
def ece_conf15(spark, sf):
    return _ece(spark, sf, *_top(), lambda c: ev.bin_left(c, 15))


@query(_ece_sql(TOP, HIT, "least(floor(c*10),9)"))
def ece_conf10(spark, sf):
    return _ece(spark, sf, *_top(), lambda c: ev.bin_left(c, 10))


@query(_ece_sql("ph", "(y=0)::INT", "greatest(ceil(c*10)-1,0)"))
def ece_rightclosed(spark, sf):
    return _ece(spark, sf, F.col("ph"), F.col("y") == 0, lambda c: ev.bin_right(c, 10))


RULES = "rules AS (SELECT e*10+o AS rule_id, e*0.02 AS min_edge, 1.5+o AS min_odds FROM (SELECT range AS e FROM range(5)), (SELECT range AS o FROM range(3)))"
EDGE = "(CAST((match_id*29) % 97 AS DOUBLE)/97*0.2-0.1)"


@query(
    f"""WITH {SETTLE}, {RULES}, j AS (SELECT rule_id, profit FROM s JOIN rules ON {EDGE} >= min_edge AND odds_h >= min_odds)
SELECT rule_id, count(*) AS bets, sum(CASE WHEN profit>0 THEN 1 ELSE 0 END)::BIGINT AS wins, round(sum(profit),6) AS profit, round(avg(profit),6) AS roi, round(coalesce(sum(profit)/nullif(stddev_samp(profit)*sqrt(count(*)),0),0),6) AS z FROM j GROUP BY 1"""
)
def rule_crossjoin_grid(spark, sf):
    return _grid(spark, sf).select("rule_id", "bets", "wins", r6("profit").alias("profit"), r6("roi").alias("roi"), r6("z").alias("z"))


def _grid(spark, sf, bets=None):
    rules = spark.range(15).select((F.floor(F.col("id") / 3) * 10 + F.col("id") % 3).alias("rule_id"), (F.floor(F.col("id") / 3) * 0.02).alias("min_edge"), (F.col("id") % 3 + 1.5).alias("min_odds"))
    bets = (_bets(spark, sf) if bets is None else bets).withColumn("edge", F.expr(EDGE))
    return ev.rule_grid(bets, rules, (F.col("edge") >= F.col("min_edge")) & (F.col("odds_h") >= F.col("min_odds")))


@query(
    f"""WITH {SETTLE}, {RULES}, j AS (SELECT rule_id, season, profit FROM s JOIN rules ON {EDGE} >= min_edge AND odds_h >= min_odds), m AS (SELECT rule_id, count(*) AS bets, sum(profit) AS profit, avg(profit) AS roi FROM j WHERE season < 1998 GROUP BY 1),
b AS (SELECT rule_id FROM m WHERE bets >= 50 ORDER BY round(roi,9) DESC, bets DESC, rule_id LIMIT 1) SELECT j.rule_id, count(*) AS test_bets, round(sum(profit),6) AS test_profit FROM j JOIN b USING (rule_id) WHERE season = 1998 GROUP BY 1"""
)
def rule_gate_select(spark, sf):
    bets = _bets(spark, sf)
    best = ev.select_rule(_grid(spark, sf, bets.where("season < 1998")), F.col("bets") >= 50, [F.round("roi", 9).desc(), F.col("bets").desc(), F.col("rule_id")])
    test = _grid(spark, sf, bets.where("season = 1998"))
    return test.join(best.select("rule_id"), "rule_id", "left_semi").select("rule_id", F.col("bets").alias("test_bets"), r6("profit").alias("test_profit"))


@query(
    f"""WITH {NOVIG}, y AS (SELECT *, {Y} AS y FROM p), g AS (SELECT a*0.25 AS alpha, 0.8+t*0.2 AS temp FROM (SELECT range AS a FROM range(5)), (SELECT range AS t FROM range(3))),
l AS (SELECT alpha, temp, y, exp(((1-alpha)*ln(ph)+alpha*ln(0.45))/temp) AS a, exp(((1-alpha)*ln(pd)+alpha*ln(0.27))/temp) AS b, exp(((1-alpha)*ln(pa)+alpha*ln(0.28))/temp) AS c FROM y, g)
SELECT round(alpha,2)::DOUBLE AS alpha, round(temp,2)::DOUBLE AS temperature, round(avg(-ln(CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END/(a+b+c))),6) AS logloss FROM l GROUP BY 1,2"""
)
def calibration_grid(spark, sf):
    return _temperature_grid(spark, sf, 5, 3).select("alpha", "temperature", r6("logloss").alias("logloss"))


def _temperature_grid(spark, sf, alphas, temperatures):
    """alpha, temperature, logloss, brier of every setting; a row's logs are taken once, before the settings multiply it."""
    n = alphas * temperatures
    grid = spark.range(n).select((F.floor(F.col("id") / temperatures) * 0.25).alias("alpha"), (F.col("id") % temperatures * 0.2 + 0.8).alias("temperature"))
    logs = lambda ps: [F.ln(p) for p in market.normalise(ps)]
    model = logs([F.lit(0.45), F.lit(0.27), F.lit(0.28)])
    s = _scored(spark, sf).select("y", *[c.alias(f"l{k}") for k, c in enumerate(logs([F.col("ph"), F.col("pd"), F.col("pa")]))])
    s = s.crossJoin(F.broadcast(grid))  # n rows
    score = [F.exp(((1 - F.col("alpha")) * F.col(f"l{k}") + F.col("alpha") * model[k]) / F.col("temperature")) for k in range(3)]
    s = s.select("alpha", "temperature", "y", *[c.alias(f"e{k}") for k, c in enumerate(score)]).withColumn("t", F.col("e0") + F.col("e1") + F.col("e2"))
    ps = [F.col(f"e{k}") / F.col("t") for k in range(3)]
    return s.groupBy(F.round("alpha", 2).alias("alpha"), F.round("temperature", 2).alias("temperature")).agg(ev.multiclass_log_loss(ps, F.col("y")).alias("logloss"), ev.multiclass_brier(ps, F.col("y")).alias("brier"))


@query(
    f"WITH {FX}, y AS (SELECT DISTINCT season FROM fx), f AS (SELECT season AS test_season FROM y ORDER BY season OFFSET 2) SELECT test_season, sum(CASE WHEN season<test_season THEN 1 ELSE 0 END)::BIGINT AS train_rows, sum(CASE WHEN season=test_season THEN 1 ELSE 0 END)::BIGINT AS test_rows FROM fx, f GROUP BY 1"
)
def walk_forward_folds(spark, sf):
    # per-season counts and a running sum: no fold reads the rows again
    c = fixtures(spark, sf).groupBy("season").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("season")
    return c.select(F.col("season").alias("test_season"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("train_rows"), F.col("n").alias("test_rows"), F.row_number().over(w).alias("k")).where("k > 2").drop("k")


@query(
    f"""WITH {FX}, r AS (SELECT fold, match_date, season, CASE WHEN season=fold THEN 'test' WHEN season=fold-1 THEN 'calibration' WHEN season=fold-2 THEN 'tune' ELSE 'train' END AS role FROM fx, (SELECT unnest([1998,1999]) AS fold) WHERE season<=fold),
t AS (SELECT fold, min(match_date) AS d FROM r WHERE role='test' GROUP BY 1), c AS (SELECT r.* FROM r JOIN t USING (fold) WHERE role='calibration' AND match_date<d), cm AS (SELECT fold, min(match_date) AS d FROM c GROUP BY 1),
u AS (SELECT r.* FROM r JOIN cm USING (fold) WHERE role='tune' AND match_date<d), um AS (SELECT fold, min(match_date) AS d FROM u GROUP BY 1), n AS (SELECT r.* FROM r JOIN um USING (fold) WHERE role='train' AND match_date<d),
a AS (SELECT * FROM r WHERE role='test' UNION ALL SELECT * FROM c UNION ALL SELECT * FROM u UNION ALL SELECT * FROM n) SELECT fold, role, count(*) AS n, min(match_date) AS first_date, max(match_date) AS last_date FROM a GROUP BY 1,2"""
)
def nested_fold_purge(spark, sf):
    f = ev.nested_roles(fixtures(spark, sf).select("season", "match_date"), [1998, 1999], "season", "match_date")
    return f.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"))


@query(
    f"""WITH {FX}, c AS (SELECT sum(CASE WHEN odds_h<=1 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN home=away THEN 1 ELSE 0 END) AS b, sum(CASE WHEN ag>hg AND odds_a<1.5 THEN 1 ELSE 0 END) AS d FROM fx)
SELECT 'odds_above_one' AS "check", CASE WHEN a=0 THEN 'pass' ELSE 'fail' END AS status, a::BIGINT AS violations FROM c UNION ALL SELECT 'two_teams', CASE WHEN b=0 THEN 'pass' ELSE 'fail' END, b::BIGINT FROM c UNION ALL SELECT 'no_short_away_wins', CASE WHEN d=0 THEN 'pass' ELSE 'fail' END, d::BIGINT FROM c"""
)
def leakage_checks(spark, sf):
    return ev.leakage_report(fixtures(spark, sf), {"odds_above_one": F.col("odds_h") <= 1, "two_teams": F.col("home") == F.col("away"), "no_short_away_wins": (F.col("ag") > F.col("hg")) & (F.col("odds_a") < 1.5)})


@query(f"WITH {SETTLE}, g AS (SELECT league, count(*) AS n, sum(profit) AS p FROM s GROUP BY 1) SELECT league AS excluded, (sum(n) OVER () - n)::BIGINT AS bets, round(sum(p) OVER () - p,6) AS profit FROM g")
def leave_one_league_out(spark, sf):
    return ev.leave_one_out(_bets(spark, sf), "league").select("excluded", "bets", r6("profit").alias("profit"))


@query(f"WITH {SETTLE}, r AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY odds_h, match_id) - 1 AS rn, count(*) OVER (PARTITION BY league) AS n FROM s) SELECT league, (floor(rn*10/n))::BIGINT AS decile, count(*) AS bets, round(avg(profit),6) AS roi FROM r GROUP BY 1,2")
def edge_deciles(spark, sf):
    r = ranked(_bets(spark, sf), ["odds_h", "match_id"], ["league"], "rn", "n").withColumn("rn", F.col("rn") - 1)
    return r.groupBy("league", F.floor(F.col("rn") * 10 / F.col("n")).alias("decile")).agg(F.count(F.lit(1)).alias("bets"), r6(F.avg("profit")).alias("roi"))


@query(f"WITH {SETTLE}, g AS (SELECT league, season, sum(profit) AS p FROM s GROUP BY 1,2) SELECT league, round(max(CASE WHEN p>0 THEN p END)/sum(CASE WHEN p>0 THEN p END),6) AS top_positive_share, sum(CASE WHEN p>0 THEN 1 ELSE 0 END)::BIGINT AS positive_seasons FROM g GROUP BY 1")
def positive_share(spark, sf):
    g = _bets(spark, sf).groupBy("league", "season").agg(F.sum("profit").alias("p"))
    up = F.when(F.col("p") > 0, F.col("p"))
    return g.groupBy("league").agg(r6(F.max(up) / F.sum(up)).alias("top_positive_share"), F.count(up).alias("positive_seasons"))


@query(f"WITH {SETTLE}, r AS (SELECT match_date, match_id, profit, row_number() OVER (PARTITION BY league ORDER BY sha256(CAST(match_id AS VARCHAR)), match_id) AS rn, league FROM s) SELECT league, count(*) AS bets, round(sum(profit),6) AS profit FROM r WHERE rn<=100 GROUP BY 1")
def random_control(spark, sf):
    w = Window.partitionBy("league").orderBy(F.sha2(F.col("match_id").cast("string"), 256), "match_id")
    return _bets(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 100").groupBy("league").agg(F.count(F.lit(1)).alias("bets"), r6(F.sum("profit")).alias("profit"))


@query()
def fuzzy_candidates(spark, sf):
    p = table(spark, sf, "part").select(F.lower("p_name").alias("name"), F.col("p_brand").alias("block"))
    return identity.fuzzy_candidates(p, p, itself=False)


@query()
def club_candidates(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("team"), F.col("p_brand").alias("competition")).distinct()
    s = table(spark, sf, "part").select(F.concat(F.col("p_name"), F.lit(" fc")).alias("club"), F.col("p_brand").alias("competition")).distinct()
    return identity.composite_candidates(p, s, [text.name_player, lambda x: text.name_compact(x), text.name_spaced], 3)


@query(f"WITH {FX} SELECT home AS team, round(avg(hg),6) AS gf, count(*) AS n FROM fx GROUP BY 1")
def home_attack(spark, sf):
    return sides(fixtures(spark, sf)).where("is_home").groupBy("team").agg(r6(F.avg("gf")).alias("gf"), F.count(F.lit(1)).alias("n"))
