"""Scalar and market queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, market, text
from ..operators import windows
from .base import FX, fixtures, query, r6, table



def odds():
    return [F.col("odds_h"), F.col("odds_d"), F.col("odds_a")]


def margin():
    return F.col("hg") - F.col("ag")


NOVIG = f"""{FX}, nv AS (SELECT *, 1/odds_h AS ih, 1/odds_d AS id, 1/odds_a AS ia, 1/odds_h+1/odds_d+1/odds_a AS tot FROM fx),
p AS (SELECT *, ih/tot AS ph, id/tot AS pd, ia/tot AS pa FROM nv)"""


@query(f"WITH {NOVIG} SELECT match_id, round(ph,6) AS p_home, round(pd,6) AS p_draw, round(pa,6) AS p_away, round(tot-1,6) AS overround FROM p")
def novig_1x2(spark, sf):
    h, d, a = market.novig(odds())
    return fixtures(spark, sf).select("match_id", r6(h).alias("p_home"), r6(d).alias("p_draw"), r6(a).alias("p_away"), r6(market.overround(odds())).alias("overround"))


@query(
    f"""WITH {FX}, x AS (SELECT match_id, CASE WHEN odds_h < 2 THEN NULL ELSE 1/odds_h END AS ih, 1/odds_d AS id, 1/odds_a AS ia FROM fx),
t AS (SELECT *, coalesce(ih,0)+id+ia AS tot FROM x)
SELECT match_id, round(ih/tot,6) AS p_home, round(id/tot,6) AS p_draw, round(ia/tot,6) AS p_away FROM t"""
)
def novig_skipna(spark, sf):
    legs = [F.when(F.col("odds_h") >= 2, F.col("odds_h")), *odds()[1:]]
    return fixtures(spark, sf).select("match_id", *[r6(p).alias(n) for p, n in zip(market.novig_skipping(legs), ("p_home", "p_draw", "p_away"))])


@query(f"WITH {NOVIG} SELECT league, count(*) AS n, round(avg(tot-1),6) AS mean_overround, round(min(tot-1),6) AS min_overround, round(max(tot-1),6) AS max_overround FROM p GROUP BY league")
def overround_by_league(spark, sf):
    o = market.overround(odds())
    return fixtures(spark, sf).groupBy("league").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(o)).alias("mean_overround"), r6(F.min(o)).alias("min_overround"), r6(F.max(o)).alias("max_overround"))


@query(
    f"""WITH {NOVIG} SELECT match_id, round(-(ph*ln(ph)+pd*ln(pd)+pa*ln(pa)),6) AS entropy, round(greatest(ph,pd,pa),6) AS top_probability,
round(ph-pa,6) AS home_away_gap, round(ln(pa/(1-pa)),6) AS away_logit FROM p"""
)
def market_entropy(spark, sf):
    p = market.novig(odds())
    return fixtures(spark, sf).select("match_id", r6(market.entropy(p)).alias("entropy"), r6(F.greatest(*p)).alias("top_probability"), r6(p[0] - p[2]).alias("home_away_gap"), r6(market.logit(p[2])).alias("away_logit"))


MODEL = "(CAST((match_id*29) % 97 AS DOUBLE)/97*0.2-0.1)"


@query(
    f"""WITH {NOVIG}, m AS (SELECT *, pa + {MODEL} AS model FROM p)
SELECT match_id, round(model,6) AS model, round(model-pa,6) AS edge, round(model*odds_a-1,6) AS ev, round(CASE WHEN model>0 THEN 1/model END,4) AS min_odds,
round(CASE WHEN ag>hg THEN odds_a-1 ELSE -1 END,6) AS profit FROM m WHERE model-pa >= 0.02 AND odds_a >= 1.5 AND odds_a <= 5"""
)
def ev_edge_rules(spark, sf):
    fx = fixtures(spark, sf).withColumn("pa", market.novig(odds())[2]).withColumn("model", F.col("pa") + F.expr(MODEL)).withColumn("edge", F.col("model") - F.col("pa"))
    fx = fx.where("edge >= 0.02 AND odds_a >= 1.5 AND odds_a <= 5")
    return fx.select("match_id", r6("model").alias("model"), r6("edge").alias("edge"), r6(market.ev(F.col("model"), F.col("odds_a"))).alias("ev"), F.round(market.fair_odds(F.col("model")), 4).alias("min_odds"), r6(market.settle_1x2(F.col("ag") > F.col("hg"), F.col("odds_a"))).alias("profit"))


SETTLE = f"""{FX}, q AS (SELECT *, CASE WHEN (CAST(round(ah_line*4) AS BIGINT)%2+2)%2=1 THEN floor(ah_line*2)/2 ELSE ah_line END AS l1,
 CASE WHEN (CAST(round(ah_line*4) AS BIGINT)%2+2)%2=1 THEN ceil(ah_line*2)/2 ELSE ah_line END AS l2 FROM fx),
h AS (SELECT *, CASE WHEN hg-ag+l1>0 THEN odds_h-1 WHEN hg-ag+l1<0 THEN -1.0 ELSE 0 END AS a, CASE WHEN hg-ag+l2>0 THEN odds_h-1 WHEN hg-ag+l2<0 THEN -1.0 ELSE 0 END AS b FROM q),
s AS (SELECT *, (a+b)/2 AS profit, CASE WHEN a>0 AND b>0 THEN 'full_win' WHEN a<0 AND b<0 THEN 'full_loss' WHEN a=0 AND b=0 THEN 'push' WHEN a>0 OR b>0 THEN 'half_win' ELSE 'half_loss' END AS label FROM h)"""


def settled(fx):
    return fx.withColumn("profit", market.handicap_profit(margin(), F.col("ah_line"), F.col("odds_h"))).withColumn("label", market.handicap_label(margin(), F.col("ah_line"), F.col("odds_h")))


@query(f"WITH {SETTLE} SELECT match_id, ah_line, label, 'SETTLED_' || upper(label) AS status, round(profit,6) AS profit FROM s")
def ah_settlement_labels(spark, sf):
    status = market.settled_status(margin(), F.col("ah_line"), F.col("odds_h"))
    return settled(fixtures(spark, sf)).select("match_id", "ah_line", "label", status.alias("status"), r6("profit").alias("profit"))


@query(
    f"""WITH {SETTLE}, c AS (SELECT *, sum(profit) OVER (PARTITION BY league, season ORDER BY match_date, match_id) AS cum FROM s),
d AS (SELECT *, max(cum) OVER (PARTITION BY league, season ORDER BY match_date, match_id) - cum AS fall FROM c)
SELECT league, season, count(*) AS bets, round(sum(profit),6) AS profit, round(avg(profit),6) AS roi, round(coalesce(sum(profit)/nullif(stddev_samp(profit)*sqrt(count(*)),0),0),6) AS z, round(max(fall),6) AS max_drawdown
FROM d GROUP BY league, season"""
)
def ah_roi_by_season(spark, sf):
    bets = settled(fixtures(spark, sf))
    falls = windows.drawdown(bets, ["league", "season"], ["match_date", "match_id"], "profit")
    z = F.coalesce(F.try_divide(F.sum("profit"), F.stddev_samp("profit") * F.sqrt(F.count(F.lit(1)))), F.lit(0.0))
    out = bets.groupBy("league", "season").agg(F.count(F.lit(1)).alias("bets"), r6(F.sum("profit")).alias("profit"), r6(F.avg("profit")).alias("roi"), r6(z).alias("z"))
    return out.join(falls, ["league", "season"]).withColumn("max_drawdown", r6("max_drawdown"))


CLOSE = "odds_h * (1 + (CAST((match_id*11) % 21 AS DOUBLE)-10)/100)"


@query(
    f"""WITH {FX}, c AS (SELECT *, {CLOSE} AS close_h, CASE WHEN match_id % 3 = 0 THEN ah_line + 0.25 ELSE ah_line END AS close_line FROM fx)
SELECT match_id, round(odds_h/close_h-1,6) AS clv, round(1/close_h-1/odds_h,6) AS shift, round(CASE WHEN ah_line=close_line THEN 1/close_h-1/odds_h END,6) AS line_gated_shift FROM c WHERE close_h > 1"""
)
def clv_shift(spark, sf):
    fx = fixtures(spark, sf).withColumn("close_h", F.expr(CLOSE)).withColumn("close_line", F.expr("CASE WHEN match_id % 3 = 0 THEN ah_line + 0.25 ELSE ah_line END")).where("close_h > 1")
    p, c = market.implied(F.col("odds_h")), market.implied(F.col("close_h"))
    return fx.select("match_id", r6(market.clv(F.col("odds_h"), F.col("close_h"))).alias("clv"), r6(c - p).alias("shift"), r6(market.gated_shift(F.col("ah_line"), F.col("close_line"), p, c)).alias("line_gated_shift"))


@query(
    f"""WITH {NOVIG}, d AS (SELECT match_id, ph, ph+pd AS a, ph+pa AS b, pd+pa AS c FROM p), n AS (SELECT *, 2*a/(a+b+c) AS x, 2*b/(a+b+c) AS y, 2*c/(a+b+c) AS z FROM d)
SELECT match_id, round((x+y-z)/2,6) AS dc_home, round((x+z-y)/2,6) AS dc_draw, round((y+z-x)/2,6) AS dc_away, round((x+y-z)/2-ph,6) AS margin_diff, (x+y-z<0 OR x+z-y<0 OR y+z-x<0) AS invalid FROM n"""
)
def double_chance(spark, sf):
    p = market.novig(odds())
    h, d, a = market.double_chance(p[0] + p[1], p[0] + p[2], p[1] + p[2])
    return fixtures(spark, sf).select("match_id", r6(h).alias("dc_home"), r6(d).alias("dc_draw"), r6(a).alias("dc_away"), r6(h - p[0]).alias("margin_diff"), ((h < 0) | (d < 0) | (a < 0)).alias("invalid"))


@query(
    f"""WITH {FX}, b AS (SELECT match_id, unnest([odds_h, odds_h*1.03, CASE WHEN match_id%4=0 THEN NULL ELSE odds_h*0.97 END, odds_h*1.01]) AS o FROM fx)
SELECT match_id, round(avg(o),6) AS mean, round(stddev_pop(o),6) AS std_pop, round(stddev_samp(o),6) AS std_samp, round(max(o)-min(o),6) AS spread, round(max(o)-avg(o),6) AS max_minus_avg, count(o) AS books FROM b GROUP BY match_id"""
)
def disagreement_dispersion(spark, sf):
    h = F.col("odds_h")
    books = [h, h * 1.03, F.when(F.col("match_id") % 4 != 0, h * 0.97), h * 1.01]
    s = market.row_stats(books)
    return fixtures(spark, sf).select("match_id", r6(s["mean"]).alias("mean"), r6(s["std"]).alias("std_pop"), r6(market.row_std(s, 1)).alias("std_samp"), r6(s["range"]).alias("spread"), r6(s["max"] - s["mean"]).alias("max_minus_avg"), s["count"].alias("books"))


@query(
    f"""WITH {FX}, b AS (SELECT *, CASE WHEN odds_h>1 AND odds_h<=2 THEN '(1, 2]' WHEN odds_h>2 AND odds_h<=3 THEN '(2, 3]' WHEN odds_h>3 AND odds_h<=4 THEN '(3, 4]' WHEN odds_h>4 AND odds_h<=6 THEN '(4, 6]' END AS bucket FROM fx)
SELECT bucket, count(*) AS n, sum(CASE WHEN hg>ag THEN 1 ELSE 0 END)::BIGINT AS wins, round(sum(CASE WHEN hg>ag THEN odds_h-1 ELSE -1 END),6) AS profit FROM b GROUP BY bucket"""
)
def odds_buckets(spark, sf):
    win = F.col("hg") > F.col("ag")
    return fixtures(spark, sf).groupBy(market.cut(F.col("odds_h"), [1, 2, 3, 4, 6]).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(win).alias("wins"), r6(F.sum(market.settle_1x2(win, F.col("odds_h")))).alias("profit"))


@query(f"WITH {FX} SELECT (isodow(match_date)-1)::INT AS weekday, (isodow(match_date)-1 IN (5,6,2,3)) AS eligible, count(*) AS n FROM fx GROUP BY 1,2")
def weekday_eligibility(spark, sf):
    return fixtures(spark, sf).groupBy(F.weekday("match_date").alias("weekday"), dates.weekday_eligible(F.col("match_date")).alias("eligible")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {FX}, s AS (SELECT (year(match_date) - CASE WHEN month(match_date)<7 THEN 1 ELSE 0 END)::INT AS season_start FROM fx)
SELECT season_start, season_start || '/' || lpad(((season_start+1)%100)::VARCHAR,2,'0') AS label, count(*) AS n FROM s GROUP BY 1,2"""
)
def season_from_date(spark, sf):
    d = F.col("match_date")
    return fixtures(spark, sf).groupBy(dates.season_start(d).alias("season_start"), dates.season_label(d).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {FX} SELECT match_id, CASE WHEN match_id%4=3 THEN NULL ELSE match_date END AS parsed FROM fx"""
)
def mixed_date_parse(spark, sf):
    d = F.col("match_date")
    raw = F.when(F.col("match_id") % 4 == 0, d.cast("string")).when(F.col("match_id") % 4 == 1, F.date_format(d, "dd/MM/yyyy")).when(F.col("match_id") % 4 == 2, F.date_format(d, "dd-MM-yyyy")).otherwise("bad")
    return fixtures(spark, sf).select("match_id", dates.parse_mixed_date(raw).alias("parsed"))


@query(
    """SELECT p_partkey, regexp_replace(lower(p_name),'[^a-z0-9]+','','g') AS compact, trim(regexp_replace(lower(p_brand),'[^a-z0-9]+',' ','g')) AS spaced,
regexp_replace(trim(regexp_replace(lower(p_type),'[^a-z0-9]+',' ','g')),' ','_','g') AS slug, array_to_string(list_sort(string_split(trim(regexp_replace(lower(p_type),'[^a-z0-9]+',' ','g')),' ')),' ') AS sorted_tokens FROM part"""
)
def name_normalise(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.name_compact(F.col("p_name")).alias("compact"), text.name_player(F.col("p_brand")).alias("spaced"), text.name_slug(F.col("p_type")).alias("slug"), text.token_sort(F.col("p_type")).alias("sorted_tokens"))


@query(
    """SELECT p_partkey, round(p_retailprice*1000,2) AS thousands, round(CASE WHEN p_partkey%2=0 THEN p_retailprice*1000000 ELSE p_retailprice*1000 END,2) AS parsed FROM part"""
)
def money_parse(spark, sf):
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    text_ = F.concat(F.lit("€"), price, F.when(F.col("p_partkey") % 2 == 0, "m").otherwise("k"))
    return table(spark, sf, "part").select("p_partkey", F.round(F.col("p_retailprice") * 1000, 2).alias("thousands"), F.round(market.parse_money(text_), 2).alias("parsed"))


@query(
    """SELECT c_custkey, round(2*6371.0088*asin(sqrt(least(1.0, pow(sin(radians((c_nationkey*5-60)-(c_custkey%120-60))/2),2)+cos(radians(c_custkey%120-60))*cos(radians(c_nationkey*5-60))*pow(sin(radians((c_nationkey*7-80)-(c_custkey%300-150))/2),2)))),3) AS km FROM customer"""
)
def haversine_distance(spark, sf):
    e = F.expr
    km = market.haversine_km(e("double(c_custkey%120-60)"), e("double(c_custkey%300-150)"), e("double(c_nationkey*5-60)"), e("double(c_nationkey*7-80)"))
    return table(spark, sf, "customer").select("c_custkey", F.round(km, 3).alias("km"))


@query(
    f"""WITH {NOVIG}, b AS (SELECT *, 0.4 AS mh, 0.3 AS md, 0.3 AS ma FROM p),
l AS (SELECT match_id, exp((0.7*ln(ph)+0.3*ln(mh))/1.2) AS a, exp((0.7*ln(pd)+0.3*ln(md))/1.2) AS b, exp((0.7*ln(pa)+0.3*ln(ma))/1.2) AS c FROM b)
SELECT match_id, round(a/(a+b+c),6) AS b_home, round(b/(a+b+c),6) AS b_draw, round(c/(a+b+c),6) AS b_away FROM l"""
)
def blend_temperature(spark, sf):
    out = market.blend(market.novig(odds()), [F.lit(0.4), F.lit(0.3), F.lit(0.3)], F.lit(0.3), F.lit(1.2))
    return fixtures(spark, sf).select("match_id", *[r6(p).alias(n) for p, n in zip(out, ("b_home", "b_draw", "b_away"))])


@query(
    f"""WITH {FX}, r AS (SELECT match_id, 0.5+CAST(match_id%20 AS DOUBLE)/10 AS lh, 0.4+CAST(match_id%15 AS DOUBLE)/10 AS la FROM fx),
g AS (SELECT match_id, i, j, exp(-lh)*pow(lh,i)/factorial(i) * exp(-la)*pow(la,j)/factorial(j) AS p FROM r, (SELECT range::INT AS i FROM range(11)), (SELECT range::INT AS j FROM range(11)))
SELECT match_id, round(sum(CASE WHEN i>j THEN p ELSE 0 END)/sum(p),6) AS p_home, round(sum(CASE WHEN i=j THEN p ELSE 0 END)/sum(p),6) AS p_draw, round(sum(CASE WHEN i+j>2 THEN p ELSE 0 END)/sum(p),6) AS p_over25, round(sum(CASE WHEN i>0 AND j>0 THEN p ELSE 0 END)/sum(p),6) AS p_btts FROM g GROUP BY match_id"""
)
def score_grid_probs(spark, sf):
    rates = fixtures(spark, sf).select("match_id", F.expr("0.5D+double(match_id%20)/10").alias("lh"), F.expr("0.4D+double(match_id%15)/10").alias("la"))
    cells = rates.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("p", market.poisson(F.col("i"), F.col("lh")) * market.poisson(F.col("j"), F.col("la")))
    share = lambda cond: r6(F.sum(F.when(cond, F.col("p")).otherwise(0.0)) / F.sum("p"))
    return cells.groupBy("match_id").agg(share(F.col("i") > F.col("j")).alias("p_home"), share(F.col("i") == F.col("j")).alias("p_draw"), share(F.col("i") + F.col("j") > 2).alias("p_over25"), share((F.col("i") > 0) & (F.col("j") > 0)).alias("p_btts"))
