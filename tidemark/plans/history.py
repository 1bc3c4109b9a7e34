"""Histories from other tables, draw features, score grids with corrections, market structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, market, text
from ..operators import joins, windows
from .base import FX, SIDES, fixtures, query, r6, sides, table
from .scalars import NOVIG, odds
from .temporal import LAST5

#: Name, value of one match for a team, and the default without history.
DRAW_STATS = (
    ("goals_for", "gf", 1.35), ("goals_against", "ga", 1.35), ("total_goals", "gf+ga", 2.7), ("draw_rate", "CASE WHEN gf=ga THEN 1 ELSE 0 END", 0.25),
    ("under_25_rate", "CASE WHEN gf+ga<=2 THEN 1 ELSE 0 END", 0.5), ("low_goals_rate", "CASE WHEN gf+ga<=1 THEN 1 ELSE 0 END", 0.25),
    ("both_score_rate", "CASE WHEN gf>0 AND ga>0 THEN 1 ELSE 0 END", 0.5), ("goal_difference_abs", "abs(gf-ga)", 1.0), ("goal_difference_signed", "gf-ga", 0.0),
)


def _draw_sql(n: int) -> str:
    stats = ", ".join(f"coalesce(avg(CASE WHEN g.rn IS NOT NULL THEN {e.replace('gf', 'g.gf').replace('ga', 'g.ga')} END),{d}) AS {k}" for k, e, d in DRAW_STATS)
    both = ", ".join(f"round(h.{k}-a.{k},6) AS {k}_diff, round(abs(h.{k}-a.{k}),6) AS {k}_abs_diff, round((h.{k}+a.{k})/2,6) AS {k}_average" for k, _, _ in DRAW_STATS)
    return f"""WITH {LAST5}, t AS (SELECT b.match_id, b.is_home, {stats} FROM b LEFT JOIN h g ON g.team=b.team AND g.rn<=b.n_before AND g.rn>b.n_before-{n} GROUP BY 1,2)
SELECT h.match_id, {both} FROM t h JOIN t a USING (match_id) WHERE h.is_home AND NOT a.is_home"""


def _draw_history(spark, sf, n):
    own = windows.last_means(sides(fixtures(spark, sf)), {k: F.expr(e) for k, e, _ in DRAW_STATS}, ["team"], n, ["match_id", "is_home"], "m")
    stat = lambda k, d: F.coalesce(F.col(f"m.{k}"), F.lit(float(d)))
    sided = own.select("match_id", "is_home", F.struct(*[stat(k, d).alias(k) for k, _, d in DRAW_STATS]).alias("s"))
    wide = sided.groupBy("match_id").agg(F.max(F.when(F.col("is_home"), F.col("s"))).alias("h"), F.max(F.when(~F.col("is_home"), F.col("s"))).alias("a"))
    cols = []
    for k, _, _ in DRAW_STATS:
        h, a = F.col(f"h.{k}"), F.col(f"a.{k}")
        cols += [r6(h - a).alias(f"{k}_diff"), r6(F.abs(h - a)).alias(f"{k}_abs_diff"), r6((h + a) / 2).alias(f"{k}_average")]
    return wide.select("match_id", *cols)


@query(_draw_sql(5))
def draw_history_5(spark, sf):
    return _draw_history(spark, sf, 5)


@query(_draw_sql(10))
def draw_history_10(spark, sf):
    return _draw_history(spark, sf, 10)


@query(
    f"""WITH {LAST5} SELECT b.match_id, b.team, b.is_home, round(coalesce(avg(CASE WHEN g.gf>g.ga THEN 3 WHEN g.gf=g.ga THEN 1 WHEN g.gf IS NOT NULL THEN 0 END),1.35),6) AS points_pg5 FROM b LEFT JOIN h g ON g.team=b.team AND g.rn<=b.n_before AND g.rn>b.n_before-5 GROUP BY 1,2,3"""
)
def points_last5(spark, sf):
    points = F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)
    own = windows.last_means(sides(fixtures(spark, sf)), {"p": points}, ["team"], 5, ["match_id", "is_home"], "m")
    return own.select("match_id", "team", "is_home", r6(F.coalesce("m.p", F.lit(1.35))).alias("points_pg5"))


PROVIDER = f"{SIDES}, pr AS (SELECT team, match_date AS d, match_id AS k, is_home AS v, gf, ga, row_number() OVER (PARTITION BY team ORDER BY match_date, match_id, is_home) AS rn FROM sides WHERE league IN ('1-URGENT','2-HIGH'))"


@query(
    f"""WITH {PROVIDER}, c AS (SELECT s.match_id, s.team, s.is_home, s.match_date, count(pr.rn) AS n, max(pr.d) AS last FROM sides s LEFT JOIN pr ON pr.team=s.team AND pr.d<s.match_date GROUP BY 1,2,3,4)
SELECT c.match_id, c.team, c.is_home, n AS history_count, n>0 AS found, (match_date-last)::BIGINT AS latest_days_ago, count(pr.rn) AS matches_w3, round(avg(pr.gf),6) AS gf_avg_w3, round(avg(pr.ga),6) AS ga_avg_w3 FROM c LEFT JOIN pr ON pr.team=c.team AND pr.rn<=n AND pr.rn>n-3 GROUP BY 1,2,3,4,5,6"""
)
def lagged_provider_stats(spark, sf):
    s = sides(fixtures(spark, sf))
    provider = s.where(F.col("league").isin("1-URGENT", "2-HIGH")).select("team", F.col("match_date").alias("d"), F.col("match_id").alias("k"), F.col("is_home").alias("v"), "gf", "ga")
    known = windows.lagged_history(provider, ["team"], "d", ["k", "v"], ["gf", "ga"], [3])
    out = joins.asof(s.select("match_id", "team", "is_home", "match_date"), known, ["team"], "match_date", "d", ["history_count", "matches_w3", "gf_avg_w3", "ga_avg_w3"], True, ["k", "v"])
    n = F.coalesce("history_count", F.lit(0))
    return out.select("match_id", "team", "is_home", n.cast("long").alias("history_count"), (n > 0).alias("found"), F.date_diff("match_date", "matched_ts").cast("long").alias("latest_days_ago"), F.coalesce("matches_w3", F.lit(0)).cast("long").alias("matches_w3"), r6("gf_avg_w3").alias("gf_avg_w3"), r6("ga_avg_w3").alias("ga_avg_w3"))


@query(
    """WITH s AS (SELECT user_id, ts::DATE AS d, event_id, value FROM events WHERE event_type='purchase'), v AS (SELECT event_id AS id, user_id, ts::DATE AS day FROM events WHERE event_type='view'),
l AS (SELECT v.id, v.user_id, max(s.d) AS d FROM v LEFT JOIN s ON s.user_id=v.user_id AND s.d<v.day GROUP BY 1,2) SELECT l.id, l.d AS snapshot, count(s.event_id) AS n, round(sum(s.value),4) AS value, round(max(s.value),4) AS top FROM l LEFT JOIN s ON s.user_id=l.user_id AND s.d=l.d GROUP BY 1,2"""
)
def snapshot_set_asof(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("date").alias("day"))
    v = e.where("event_type = 'view'").select(F.col("event_id").alias("id"), "user_id", "day")
    s = e.where("event_type = 'purchase'").select("user_id", F.col("day").alias("snapshot"), "event_id", "value")
    both = joins.latest_set(v, s, ["user_id"], "day", "snapshot")
    return both.groupBy("id", "snapshot").agg(F.count("event_id").alias("n"), F.round(F.sum("value"), 4).alias("value"), F.round(F.max("value"), 4).alias("top"))


RHO = -0.05


@query(
    f"""WITH {FX}, r AS (SELECT match_id, ah_line, 0.5+CAST(match_id%20 AS DOUBLE)/10 AS lh, 0.4+CAST(match_id%15 AS DOUBLE)/10 AS la FROM fx),
g AS (SELECT match_id, ah_line, i, j, exp(-lh)*pow(lh,i)/factorial(i) * exp(-la)*pow(la,j)/factorial(j) * CASE WHEN i=0 AND j=0 THEN greatest(0,1-lh*la*({RHO})) WHEN i=0 AND j=1 THEN greatest(0,1+lh*({RHO})) WHEN i=1 AND j=0 THEN greatest(0,1+la*({RHO})) WHEN i=1 AND j=1 THEN 1-({RHO}) ELSE 1 END AS p FROM r, (SELECT range::INT AS i FROM range(11)), (SELECT range::INT AS j FROM range(11))),
u AS (SELECT *, CASE WHEN (CAST(round(ah_line*4) AS BIGINT)%2+2)%2=1 THEN (sign(i-j+floor(ah_line*2)/2)+sign(i-j+ceil(ah_line*2)/2))/2 ELSE sign(i-j+ah_line) END AS units FROM g)
SELECT match_id, round(sum(CASE WHEN i=j THEN p ELSE 0 END)/sum(p),6) AS p_draw, round(sum(CASE WHEN i+j>1 THEN p ELSE 0 END)/sum(p),6) AS p_over15, round(sum(p*units)/sum(p),6) AS home_units, round(-sum(p*units)/sum(p),6) AS away_units FROM u GROUP BY 1"""
)
def handicap_expected_units(spark, sf):
    # cells of a fixture are made beside it and summed before any shuffle
    fx = fixtures(spark, sf).select("match_id", "ah_line", F.expr("0.5D+double(match_id%20)/10").alias("lh"), F.expr("0.4D+double(match_id%15)/10").alias("la"))
    cells = fx.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(10))))
    i, j = F.col("i"), F.col("j")
    p = market.poisson(i, F.col("lh")) * market.poisson(j, F.col("la")) * market.low_score_factor(i, j, F.col("lh"), F.col("la"), RHO)
    cells = cells.select("match_id", "i", "j", p.alias("p"), market.handicap_units(i - j, F.col("ah_line")).alias("u"))
    share = lambda x: F.sum(F.col("p") * x) / F.sum("p")
    flag = lambda cond: cond.cast("double")
    return cells.groupBy("match_id").agg(r6(share(flag(i == j))).alias("p_draw"), r6(share(flag(i + j > 1))).alias("p_over15"), r6(share(F.col("u"))).alias("home_units"), r6(-share(F.col("u"))).alias("away_units"))


CUTS = [0.0, 0.22, 0.25, 0.28, 0.31, 0.35, 1.0]


@query(
    f"""WITH {NOVIG}, f AS (SELECT *, greatest(ph,pd,pa) AS top, least(ph,pd,pa) AS low FROM p), g AS (SELECT *, CASE WHEN ph=top THEN 0.0 WHEN pd=top THEN 1.0 ELSE 2.0 END::DOUBLE AS code FROM f)
SELECT match_id, round(top,6) AS favourite_probability, round(low,6) AS underdog_probability, code AS favourite_side_code, (code=0)::INT::DOUBLE AS home_is_favourite, (code=2)::INT::DOUBLE AS away_is_favourite,
CASE WHEN pd>0 AND pd<=0.22 THEN 0.0 WHEN pd<=0.25 THEN 1 WHEN pd<=0.28 THEN 2 WHEN pd<=0.31 THEN 3 WHEN pd<=0.35 THEN 4 ELSE 5 END::DOUBLE AS draw_bucket, CASE WHEN season<1994 THEN 0.0 WHEN season<1996 THEN 1 WHEN season<1998 THEN 2 ELSE 3 END::DOUBLE AS season_era, (league='1-URGENT')::INT::DOUBLE AS league_urgent FROM g"""
)
def structure_flags(spark, sf):
    ps = market.novig(odds())
    flags = {k: (r6(v) if k.endswith("probability") else v).alias(k) for k, v in market.favourite_flags(ps).items()}
    return fixtures(spark, sf).select("match_id", *flags.values(), market.ordinal(ps[1], CUTS).alias("draw_bucket"), market.era(F.col("season"), (1994, 1996, 1998)).alias("season_era"), market.one_hot(F.col("league"), ["1-URGENT"])["1-URGENT"].alias("league_urgent"))


@query(
    f"""WITH {NOVIG}, b AS (SELECT match_id, ph, pd, pa, odds_h AS av, odds_h*1.04 AS mx, odds_h*1.01 AS b1, odds_h*0.99 AS sharp FROM p) SELECT match_id, round(mx-av,6) AS max_gap, round(b1-av,6) AS soft_gap, round(sharp-av,6) AS sharp_gap, round(sharp-b1,6) AS sharp_soft, round(pd-least(ph,pa),6) AS draw_pressure, round(abs(ph-pa),6) AS favourite_strength FROM b"""
)
def bookmaker_gaps(spark, sf):
    h, (ph, pd, pa) = F.col("odds_h"), market.novig(odds())
    return fixtures(spark, sf).select("match_id", r6(h * 1.04 - h).alias("max_gap"), r6(h * 1.01 - h).alias("soft_gap"), r6(h * 0.99 - h).alias("sharp_gap"), r6(h * 0.99 - h * 1.01).alias("sharp_soft"), r6(pd - F.least(ph, pa)).alias("draw_pressure"), r6(F.abs(ph - pa)).alias("favourite_strength"))


@query(f"WITH {FX}, t AS (SELECT match_id, CASE WHEN match_id%7=0 THEN NULL ELSE 1/odds_h END AS p, 1/odds_a AS q FROM fx), n AS (SELECT match_id, p/(p+q) AS a, q/(p+q) AS b FROM t) SELECT match_id, round(a,6) AS p_over, round(b,6) AS p_under, round(ln(a/(1-a)),6) AS logit FROM n")
def two_way_probs(spark, sf):
    p, q = F.when(F.col("match_id") % 7 != 0, market.implied(F.col("odds_h"))), market.implied(F.col("odds_a"))
    a, b = market.two_way(p, q)
    return fixtures(spark, sf).select("match_id", r6(a).alias("p_over"), r6(b).alias("p_under"), r6(market.logit(a)).alias("logit"))


@query(
    f"""WITH {FX}, t AS (SELECT match_id, match_date, match_id%24 AS h, match_id%60 AS m FROM fx) SELECT match_id, (CASE WHEN match_id%5=0 THEN match_date::TIMESTAMP ELSE match_date::TIMESTAMP + to_hours(h::INT) + to_minutes(m::INT) END) AS kickoff, match_date AS from_path FROM t"""
)
def kickoff_and_path_dates(spark, sf):
    d, m = F.col("match_date"), F.col("match_id")
    time = F.when(m % 5 != 0, F.concat((m % 24).cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))).otherwise(" ")
    path = F.concat(F.lit("raw/"), F.year(d).cast("string"), F.lit("/"), F.date_format(d, "MMMM"), F.lit("/"), F.dayofmonth(d).cast("string"), F.lit("/1.bz2"))
    return fixtures(spark, sf).select("match_id", dates.at_time(d, time).cast("timestamp_ntz").alias("kickoff"), dates.path_date(path).alias("from_path"))


@query(
    """WITH p AS (SELECT p_partkey, CASE p_partkey%6 WHEN 0 THEN 'Goalkeeper' WHEN 1 THEN 'Right-Back' WHEN 2 THEN 'Central Midfield' WHEN 3 THEN 'Left Winger' WHEN 4 THEN 'GK' ELSE 'coach' END AS pos FROM part)
SELECT CASE WHEN pos IN ('Goalkeeper','GK') THEN 'goalkeeper' WHEN pos='Right-Back' THEN 'defender' WHEN pos='Central Midfield' THEN 'midfielder' WHEN pos='Left Winger' THEN 'attacker' ELSE 'unknown' END AS position_group, count(*) AS n FROM p GROUP BY 1"""
)
def position_groups(spark, sf):
    names = ["Goalkeeper", "Right-Back", "Central Midfield", "Left Winger", "GK", "coach"]
    pos = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").groupBy(market.position_group(pos).alias("position_group")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {FX}, y AS (SELECT league, season, avg(odds_h) AS m, stddev_pop(odds_h) AS s, count(*) AS n FROM fx GROUP BY 1,2), k AS (SELECT fx.league, fx.season, avg(pow((odds_h-m)/s,3)) AS skew FROM fx JOIN y USING (league, season) GROUP BY 1,2)
SELECT league, round(avg(skew),5) AS mean_skew, round(max(skew)-min(skew),5) AS skew_range, count(*) AS years FROM k GROUP BY 1"""
)
def skew_by_year(spark, sf):
    y = fixtures(spark, sf).groupBy("league", "season").agg(F.skewness("odds_h").alias("skew"))
    return y.groupBy("league").agg(F.round(F.avg("skew"), 5).alias("mean_skew"), F.round(F.max("skew") - F.min("skew"), 5).alias("skew_range"), F.count(F.lit(1)).alias("years"))


@query(
    """SELECT c_custkey, trim(regexp_replace(regexp_replace(lower('FC ' || replace(c_mktsegment,'I','Í') || ' & The ' || c_custkey),'[^a-z0-9&]+',' ','g'),'x','x','g')) IS NOT NULL AS ok, regexp_replace(lower(c_mktsegment) || ' and the ' || c_custkey,'\\s+',' ','g') AS spaced, lower(c_mktsegment) || ' and ' || c_custkey AS exchange FROM customer"""
)
def accented_names(spark, sf):
    raw = F.concat(F.lit("FC "), F.replace("c_mktsegment", F.lit("I"), F.lit("Í")), F.lit(" & The "), F.col("c_custkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", raw.isNotNull().alias("ok"), text.name_spaced(raw).alias("spaced"), text.name_exchange(raw).alias("exchange"))
