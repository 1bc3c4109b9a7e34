"""Further operators of each family: predicates, projections, summaries, folds and controls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import evaluation as ev
from ..operators import replay, windows
from .analysis import Y
from .base import FX, SIDES, fixtures, query, r6, sides, table
from .scalars import NOVIG, SETTLE, settled
from .streams import S, _stream


@query(
    f"""WITH {SETTLE}, g AS (SELECT season, league, count(*) AS n, sum(profit) AS p FROM s GROUP BY 1,2), t AS (SELECT season, count(*) AS n, avg(profit) AS roi, stddev_samp(profit)/sqrt(count(*)) AS se FROM s GROUP BY 1)
SELECT g.season, any_value(t.n)::BIGINT AS bets, round(any_value(t.roi),6) AS roi, round(any_value(t.roi-t.se),6) AS lcb, sum(CASE WHEN p>0 THEN 1 ELSE 0 END)::BIGINT AS positive_leagues, round(coalesce(max(CASE WHEN p>0 THEN p END)/sum(CASE WHEN p>0 THEN p END),1),6) AS max_share FROM g JOIN t USING (season) GROUP BY 1"""
)
def rule_metrics_lcb(spark, sf):
    # one pass per (season, league), then sums of sums: mean and deviation from n, sum and sum of squares
    g = settled(fixtures(spark, sf)).groupBy("season", "league").agg(F.count(F.lit(1)).alias("n"), F.sum("profit").alias("p"), F.sum(F.col("profit") * F.col("profit")).alias("q"))
    n, p, q = F.sum("n"), F.sum("p"), F.sum("q")
    up = F.when(F.col("p") > 0, F.col("p"))
    se = F.sqrt((q - p * p / n) / (n - 1)) / F.sqrt(n)
    return g.groupBy("season").agg(n.alias("bets"), r6(p / n).alias("roi"), r6(p / n - se).alias("lcb"), F.count(up).alias("positive_leagues"), r6(F.coalesce(F.max(up) / F.sum(up), F.lit(1.0))).alias("max_share"))


@query(f"WITH {SETTLE}, w AS (SELECT league, sum(profit) OVER (PARTITION BY league ORDER BY match_date, match_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS v, row_number() OVER (PARTITION BY league ORDER BY match_date, match_id) AS rn FROM s) SELECT league, round(max(v),6) AS best50, round(min(v),6) AS worst50 FROM w WHERE rn>=50 GROUP BY 1")
def window_extremes(spark, sf):
    order = Window.partitionBy("league").orderBy("match_date", "match_id")
    w = settled(fixtures(spark, sf)).select("league", F.sum("profit").over(order.rowsBetween(-49, 0)).alias("v"), F.row_number().over(order).alias("rn")).where("rn >= 50")
    return w.groupBy("league").agg(r6(F.max("v")).alias("best50"), r6(F.min("v")).alias("worst50"))


@query(f"WITH {FX}, y AS (SELECT league, season, avg(odds_h) AS m, count(*) AS n FROM fx GROUP BY 1,2) SELECT league, round(avg(m),6) AS mean_of_years, round(stddev_samp(m),6) AS sd_of_years, round(sum(m*n)/sum(n),6) AS weighted FROM y GROUP BY 1")
def stability_by_year(spark, sf):
    y = fixtures(spark, sf).groupBy("league", "season").agg(F.avg("odds_h").alias("m"), F.count(F.lit(1)).alias("n"))
    return y.groupBy("league").agg(r6(F.avg("m")).alias("mean_of_years"), r6(F.stddev_samp("m")).alias("sd_of_years"), r6(F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("weighted"))


@query(f"WITH {FX} SELECT match_id, round(avg(CASE WHEN hg>ag THEN 1.0 ELSE 0 END) OVER w50,6) AS home50, round(avg(CASE WHEN hg=ag THEN 1.0 ELSE 0 END) OVER w100,6) AS draw100 FROM fx WINDOW w50 AS (PARTITION BY league ORDER BY match_date, match_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), w100 AS (PARTITION BY league ORDER BY match_date, match_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)")
def league_outcome_rates(spark, sf):
    w = lambda n: windows.prior_rows(["league"], ["match_date", "match_id"], n)
    rate = lambda cond, n: r6(F.avg(F.when(cond, 1.0).otherwise(0.0)).over(w(n)))
    return fixtures(spark, sf).select("match_id", rate(F.col("hg") > F.col("ag"), 50).alias("home50"), rate(F.col("hg") == F.col("ag"), 100).alias("draw100"))


@query(f"WITH {SIDES} SELECT match_id, team, is_home, lag(match_date) OVER w AS previous, row_number() OVER w - 1 AS cumcount FROM sides WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id, is_home)")
def lag_and_cumcount(spark, sf):
    w = Window.partitionBy("team").orderBy("match_date", "match_id", "is_home")
    return sides(fixtures(spark, sf)).select("match_id", "team", "is_home", F.lag("match_date").over(w).alias("previous"), (F.row_number().over(w) - 1).cast("long").alias("cumcount"))


@query(
    f"""WITH {FX}, d AS (SELECT *, CASE WHEN odds_h<=3 THEN odds_h END AS b1 FROM fx) SELECT match_id, CASE WHEN b1 IS NOT NULL THEN 'first' WHEN match_id%2=0 THEN 'second' END AS source, round(CASE WHEN b1 IS NOT NULL THEN b1 WHEN match_id%2=0 THEN odds_h END,6) AS h, round(CASE WHEN b1 IS NOT NULL OR match_id%2=0 THEN odds_a END,6) AS a FROM d"""
)
def complete_triplet(spark, sf):
    # the first complete source as a whole, not the first value of each column
    fx = fixtures(spark, sf)
    first = F.when(F.col("odds_h") <= 3, F.struct(F.lit("first").alias("source"), F.col("odds_h").alias("h"), F.col("odds_a").alias("a")))
    second = F.when(F.col("match_id") % 2 == 0, F.struct(F.lit("second").alias("source"), F.col("odds_h").alias("h"), F.col("odds_a").alias("a")))
    return fx.select("match_id", F.coalesce(first, second).alias("t")).select("match_id", "t.source", r6("t.h").alias("h"), r6("t.a").alias("a"))


@query(f"WITH {NOVIG}, s AS (SELECT match_id, 'home' AS side, odds_h AS odds, ph AS p, hg>ag AS won FROM p UNION ALL SELECT match_id, 'draw', odds_d, pd, hg=ag FROM p UNION ALL SELECT match_id, 'away', odds_a, pa, ag>hg FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY p DESC, side) AS rn FROM s) SELECT match_id, side, round(odds,6) AS odds, round(p,6) AS p, won FROM r WHERE rn=1")
def best_side_per_fixture(spark, sf):
    o = {"home": "odds_h", "draw": "odds_d", "away": "odds_a"}
    won = {"home": F.col("hg") > F.col("ag"), "draw": F.col("hg") == F.col("ag"), "away": F.col("ag") > F.col("hg")}
    total = sum((1 / F.col(c) for c in o.values()), F.lit(0.0))
    side = [F.struct((1 / F.col(c) / total).alias("p"), F.lit(s).alias("side"), F.col(c).alias("odds"), won[s].alias("won")) for s, c in o.items()]
    best = F.array_sort(F.array(*side), lambda a, b: F.when(F.round(a["p"], 12) > F.round(b["p"], 12), -1).when(F.round(a["p"], 12) < F.round(b["p"], 12), 1).when(a["side"] < b["side"], -1).otherwise(1))
    return fixtures(spark, sf).select("match_id", F.get(best, F.lit(0)).alias("b")).select("match_id", "b.side", r6("b.odds").alias("odds"), r6("b.p").alias("p"), "b.won")


@query(f"WITH {FX} SELECT CASE WHEN odds_a<1.5 THEN 'odds_too_short' WHEN odds_a>5 THEN 'odds_too_long' WHEN isodow(match_date) IN (1,2,5) THEN 'weekday' WHEN ah_line<=-1.25 THEN 'selected' ELSE 'no_edge' END AS reason, count(*) AS n FROM fx GROUP BY 1")
def skip_reasons(spark, sf):
    reason = F.when(F.col("odds_a") < 1.5, "odds_too_short").when(F.col("odds_a") > 5, "odds_too_long").when(~dates.weekday_eligible(F.col("match_date")), "weekday").when(F.col("ah_line") <= -1.25, "selected").otherwise("no_edge")
    return fixtures(spark, sf).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SETTLE}, c AS (SELECT league, season, profit, ah_line FROM s WHERE ah_line<=-1.25), y AS (SELECT season, count(*) AS bets, sum(profit) AS profit, avg(profit) AS roi FROM c GROUP BY 1) SELECT season, bets, round(profit,6) AS profit, round(roi,6) AS roi, round(sum(profit) OVER (ORDER BY season),6) AS cumulative FROM y")
def big_favourite_by_season(spark, sf):
    y = settled(fixtures(spark, sf)).where("ah_line <= -1.25").groupBy("season").agg(F.count(F.lit(1)).alias("bets"), F.sum("profit").alias("profit"), F.avg("profit").alias("roi"))
    return y.select("season", "bets", r6("profit").alias("profit"), r6("roi").alias("roi"), r6(F.sum("profit").over(Window.orderBy("season"))).alias("cumulative"))


@query(f"WITH {FX}, t AS (SELECT season AS fold, quantile_cont(odds_a,0.8) AS cut FROM fx GROUP BY 1) SELECT f.season, round(any_value(t.cut),6) AS cut, count(*) AS picks FROM fx f JOIN t ON t.fold=f.season-1 WHERE f.odds_a>=t.cut GROUP BY 1")
def threshold_from_prior_season(spark, sf):
    fx = fixtures(spark, sf)
    cuts = fx.groupBy((F.col("season") + 1).alias("season")).agg(F.percentile("odds_a", F.lit(0.8)).alias("cut"))
    return fx.join(cuts, "season").where("odds_a >= cut").groupBy("season").agg(r6(F.first("cut")).alias("cut"), F.count(F.lit(1)).alias("picks"))


@query(f"WITH {FX}, b AS (SELECT league, min(match_date) AS d FROM fx WHERE season=1998 GROUP BY 1) SELECT fx.league, count(*) AS kept, max(match_date) AS last_date FROM fx JOIN b ON b.league=fx.league WHERE match_date < b.d - 7 GROUP BY 1")
def boundary_purge_7d(spark, sf):
    fx = fixtures(spark, sf)
    b = F.min(F.when(F.col("season") == 1998, F.col("match_date"))).over(Window.partitionBy("league"))
    return fx.withColumn("d", b).where(F.col("match_date") < F.date_sub("d", 7)).groupBy("league").agg(F.count(F.lit(1)).alias("kept"), F.max("match_date").alias("last_date"))


@query(f"WITH {FX} SELECT league, round(avg(abs(odds_h-odds_a)),6) AS mae, round(sqrt(avg(pow(odds_h-odds_a,2))),6) AS rmse, round(corr(odds_h,odds_a),6) AS corr, round(avg(CASE WHEN sign(odds_h-2.5)=sign(odds_a-2.5) THEN 1.0 ELSE 0 END),6) AS directional FROM fx GROUP BY 1")
def regression_metrics(spark, sf):
    a, b = F.col("odds_h"), F.col("odds_a")
    return fixtures(spark, sf).groupBy("league").agg(r6(F.avg(F.abs(a - b))).alias("mae"), r6(F.sqrt(F.avg(F.pow(a - b, 2)))).alias("rmse"), r6(F.corr(a, b)).alias("corr"), r6(F.avg(F.when(F.signum(a - 2.5) == F.signum(b - 2.5), 1.0).otherwise(0.0))).alias("directional"))


@query(f"WITH {FX}, z AS (SELECT match_id, (odds_h-avg(odds_h) OVER (PARTITION BY league))/stddev_pop(odds_h) OVER (PARTITION BY league) AS a, (odds_a-avg(odds_a) OVER (PARTITION BY league))/stddev_pop(odds_a) OVER (PARTITION BY league) AS b FROM fx) SELECT match_id, round((a+b)/2,6) AS score FROM z")
def normalised_score_average(spark, sf):
    fx = fixtures(spark, sf).select("match_id", "league", "odds_h", "odds_a")
    stats = fx.groupBy("league").agg(*[f(c).alias(f"{n}_{c}") for c in ("odds_h", "odds_a") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [(F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in ("odds_h", "odds_a")]
    return fx.join(stats, "league").select("match_id", r6((z[0] + z[1]) / 2).alias("score"))


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT round(l_extendedprice,6)) AS n_prices FROM lineitem GROUP BY 1,2 HAVING count(DISTINCT round(l_extendedprice,6))>2")
def price_conflicts(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count_distinct(F.round("l_extendedprice", 6)).alias("n_prices"))
    return g.where("n_prices > 2")


@query(f"WITH {FX} SELECT league, season, count(*) AS n, CASE WHEN count(*)<350 THEN 'too_few' WHEN count(*)>460 THEN 'too_many' ELSE 'plausible' END AS status FROM fx GROUP BY 1,2")
def implausible_counts(spark, sf):
    n = F.count(F.lit(1))
    return fixtures(spark, sf).groupBy("league", "season").agg(n.alias("n"), F.when(n < 350, "too_few").when(n > 460, "too_many").otherwise("plausible").alias("status"))


@query(f"WITH {NOVIG}, y AS (SELECT *, {Y} AS y FROM p) SELECT y AS outcome, CASE WHEN ph>=pd AND ph>=pa THEN 0 WHEN pd>=pa THEN 1 ELSE 2 END AS predicted, count(*) AS n FROM y GROUP BY 1,2")
def confusion_matrix(spark, sf):
    # smaller odds are larger probabilities: the argmax needs no normalisation
    predicted = F.when((F.col("odds_h") <= F.col("odds_d")) & (F.col("odds_h") <= F.col("odds_a")), 0).when(F.col("odds_d") <= F.col("odds_a"), 1).otherwise(2)
    return fixtures(spark, sf).groupBy(F.expr(Y).alias("outcome"), predicted.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S}, l AS (SELECT *, ts < lag(ts) OVER (PARTITION BY market ORDER BY pos) AS back FROM s) SELECT market, count(*) AS updates, sum(CASE WHEN back THEN 1 ELSE 0 END)::BIGINT AS non_monotonic, sum(CASE WHEN ts IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing_ts FROM l GROUP BY 1")
def stream_order_faults(spark, sf):
    return replay.order_faults(_stream(spark, sf).withColumn("line_no", F.col("pos")))


@query("WITH w AS (SELECT unnest(generate_series(date_trunc('hour', ts), date_trunc('hour', ts) + INTERVAL 0 HOUR, INTERVAL 1 HOUR)) AS h, event_type FROM events) SELECT event_type, count(DISTINCT h) AS hours FROM w GROUP BY 1")
def active_hours(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct(F.date_trunc("hour", "ts")).alias("hours"))


@query(f"WITH {SIDES}, m AS (SELECT team, month(match_date)::INT AS month, avg(gf) AS normal, count(*) AS samples FROM sides GROUP BY 1,2) SELECT s.match_id, s.team, s.is_home, round(s.gf-m.normal,6) AS shock FROM sides s JOIN m ON m.team=s.team AND m.month=month(s.match_date)")
def monthly_normal_shock(spark, sf):
    s = sides(fixtures(spark, sf)).withColumn("month", F.month("match_date"))
    normals = s.groupBy("team", "month").agg(F.avg("gf").alias("normal"))
    return s.join(normals, ["team", "month"]).select("match_id", "team", "is_home", r6(F.col("gf") - F.col("normal")).alias("shock"))


@query("SELECT t1.c_custkey AS a, t2.c_custkey AS b FROM customer t1 JOIN customer t2 ON t1.c_nationkey=t2.c_nationkey AND t1.c_mktsegment=t2.c_mktsegment AND t1.c_custkey<t2.c_custkey WHERE abs(t1.c_acctbal-t2.c_acctbal)<=25")
def near_value_pairs(spark, sf):
    # equality on value buckets, then the test: no pair farther than one bucket is made
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal", F.floor(F.col("c_acctbal") / 25).alias("k"))
    l = c.select(F.col("c_custkey").alias("a"), "c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("x"), F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"))  # noqa: E741
    r = c.select(F.col("c_custkey").alias("b"), "c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("y"), "k")
    return l.join(r, ["c_nationkey", "c_mktsegment", "k"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("x") - F.col("y")) <= 25)).select("a", "b")


@query(f"WITH {SETTLE}, m AS (SELECT date_trunc('month', match_date)::DATE AS month, count(*) AS bets, sum(profit) AS profit FROM s GROUP BY 1) SELECT month, bets, round(profit,6) AS profit FROM m")
def month_summary(spark, sf):
    s = settled(fixtures(spark, sf))
    return ev.bet_summary(s.withColumn("month", F.trunc("match_date", "month")), ["month"]).select("month", "bets", r6("profit").alias("profit"))
