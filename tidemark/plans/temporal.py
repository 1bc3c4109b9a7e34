"""Point-in-time window features and joins in time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, windows
from .base import FX, SIDES, fixtures, query, r6, sides, table

DAY = "(match_date - DATE '1970-01-01')"
PREV = f"OVER (PARTITION BY team ORDER BY {DAY} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"WITH {SIDES} SELECT match_id, team, is_home, coalesce({DAY} - max({DAY}) {PREV}, 14)::BIGINT AS rest FROM sides")
def schedule_rest(spark, sf):
    return sides(fixtures(spark, sf)).select("match_id", "team", "is_home", windows.rest_days(["team"]).cast("long").alias("rest"))


@query(
    f"""WITH {SIDES} SELECT match_id, team, is_home, count(*) OVER (PARTITION BY team ORDER BY {DAY} RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS n7,
count(*) OVER (PARTITION BY team ORDER BY {DAY} RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING) AS n14, count(*) OVER (PARTITION BY team ORDER BY {DAY} RANGE BETWEEN 21 PRECEDING AND 1 PRECEDING) AS n21, count(*) {PREV} AS n_before FROM sides"""
)
def schedule_recent_counts(spark, sf):
    n = F.count(F.lit(1))
    return sides(fixtures(spark, sf)).select("match_id", "team", "is_home", *[n.over(windows.last_days(["team"], d)).alias(f"n{d}") for d in (7, 14, 21)], n.over(windows.before_date(["team"])).alias("n_before"))


@query(
    f"""WITH {SIDES}, n AS (SELECT *, row_number() OVER (PARTITION BY season, team ORDER BY match_date, match_id, is_home) - 1 AS before FROM sides)
SELECT match_id, team, is_home, before AS season_matches_before, before < 5 AS first_5, before < 10 AS first_10 FROM n"""
)
def season_matches_before(spark, sf):
    n = F.row_number().over(Window.partitionBy("season", "team").orderBy("match_date", "match_id", "is_home")) - 1
    return sides(fixtures(spark, sf)).withColumn("n", n.cast("long")).select("match_id", "team", "is_home", F.col("n").alias("season_matches_before"), (F.col("n") < 5).alias("first_5"), (F.col("n") < 10).alias("first_10"))


@query(f"WITH {SIDES}, f AS (SELECT team, league, min(season) AS first_season FROM sides GROUP BY 1,2) SELECT s.match_id, s.team, s.is_home, f.first_season, s.season = f.first_season AS new_to_league FROM sides s JOIN f USING (team, league)")
def new_to_league(spark, sf):
    first = F.min("season").over(Window.partitionBy("team", "league"))
    return sides(fixtures(spark, sf)).select("match_id", "team", "is_home", first.alias("first_season"), (F.col("season") == first).alias("new_to_league"))


LAST5 = f"""{SIDES}, h AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date, match_id, is_home) AS rn, min(0) OVER () AS z FROM sides),
b AS (SELECT h.*, (SELECT count(*) FROM h g WHERE g.team=h.team AND g.match_date<h.match_date) AS n_before FROM h)"""


@query(
    f"""WITH {LAST5} SELECT b.match_id, b.team, b.is_home, round(avg(g.gf),6) AS gf5, round(avg(g.ga),6) AS ga5, count(g.gf) AS n5
FROM b LEFT JOIN h g ON g.team=b.team AND g.rn<=b.n_before AND g.rn>b.n_before-5 GROUP BY 1,2,3"""
)
def rolling_last5_dategroup(spark, sf):
    # ranked rows: the history before a date is the first n_before ranks, so its last five are a frame of sums
    s = sides(fixtures(spark, sf))
    order = Window.partitionBy("team").orderBy("match_date", "match_id", "is_home")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("rn", F.row_number().over(order)).withColumn("n_before", F.count(F.lit(1)).over(windows.before_date(["team"])))
    s = s.withColumn("own", F.col("rn") - F.col("n_before") - 1)  # same-date rows before this one
    # lag by the same-date rows: cumulative sums up to the last earlier date and five before it
    cum = s.withColumn("cf", F.sum("gf").over(run)).withColumn("ca", F.sum("ga").over(run))
    g = Window.partitionBy("team", "match_date").orderBy("match_id", "is_home").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.col("own") == 0
    lag = lambda c, k: F.max(F.when(first, F.coalesce(F.col(f"{c}_{k}"), F.lit(0)))).over(g)
    cum = cum.select("*", *[F.lag(c, k).over(order).alias(f"{c}_{k}") for c in ("cf", "ca") for k in (1, 6)])
    n = F.least(F.col("n_before"), F.lit(5))
    mean = lambda c: r6(F.when(n > 0, (lag(c, 1) - lag(c, 6)) / n))
    return cum.select("match_id", "team", "is_home", mean("cf").alias("gf5"), mean("ca").alias("ga5"), n.cast("long").alias("n5"))


@query(
    f"""WITH {LAST5} SELECT b.match_id, b.team, b.is_home, round(coalesce(sum(g.gf),0),6)::DOUBLE AS seq_sum, count(g.gf) AS seq_len, (5-count(g.gf))::BIGINT AS pads
FROM b LEFT JOIN h g ON g.team=b.team AND g.rn<=b.n_before AND g.rn>b.n_before-5 GROUP BY 1,2,3"""
)
def sequence_last5(spark, sf):
    s = sides(fixtures(spark, sf))
    s = windows.last_n(s, "gf", ["team"], 5, ["match_id", "is_home"], "seq").withColumn("padded", windows.padded(F.col("seq"), 5))
    return s.select("match_id", "team", "is_home", r6(F.aggregate("padded", F.lit(0.0), lambda a, x: a + x)).alias("seq_sum"), F.size("seq").cast("long").alias("seq_len"), (F.size("padded") - F.size("seq")).cast("long").alias("pads"))


@query(
    f"""WITH {SIDES} SELECT match_id, team, is_home, round(CASE WHEN count(gf) OVER w >= 2 THEN avg(gf) OVER w END,6) AS gf_w5 FROM sides
WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id, is_home ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""
)
def rolling_shift1_w5(spark, sf):
    return sides(fixtures(spark, sf)).select("match_id", "team", "is_home", r6(windows.rolling_mean("gf", ["team"], ["match_date", "match_id", "is_home"], 5, 2)).alias("gf_w5"))


@query(
    f"""WITH {FX} SELECT match_id, league, round(coalesce(avg(hg+ag) OVER w, 2.70),6) AS avg_goals, round(coalesce(avg(CASE WHEN hg+ag>2 THEN 1.0 ELSE 0 END) OVER w, 0.5),6) AS over_rate, count(*) OVER w AS n FROM fx
WINDOW w AS (PARTITION BY league ORDER BY {DAY} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def league_running_avg(spark, sf):
    w = windows.before_date(["league"])
    goals = F.col("hg") + F.col("ag")
    return fixtures(spark, sf).select("match_id", "league", r6(F.coalesce(F.avg(goals).over(w), F.lit(2.70))).alias("avg_goals"), r6(F.coalesce(F.avg(F.when(goals > 2, 1.0).otherwise(0.0)).over(w), F.lit(0.5))).alias("over_rate"), F.count(F.lit(1)).over(w).alias("n"))


@query(
    f"""WITH {SIDES} SELECT match_id, team, is_home, round(avg(gf) OVER w,6) AS venue_gf, round(avg(ga) OVER w,6) AS venue_ga, count(*) OVER w AS n FROM sides
WINDOW w AS (PARTITION BY team, is_home ORDER BY {DAY} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def venue_form(spark, sf):
    w = windows.before_date(["team", "is_home"])
    return sides(fixtures(spark, sf)).select("match_id", "team", "is_home", r6(F.avg("gf").over(w)).alias("venue_gf"), r6(F.avg("ga").over(w)).alias("venue_ga"), F.count(F.lit(1)).over(w).alias("n"))


PTS = "CASE WHEN gf>ga THEN 3 WHEN gf=ga THEN 1 ELSE 0 END"


@query(
    f"""WITH {SIDES} SELECT match_id, team, is_home, round(avg({PTS}) OVER w,6) AS ppg, round(avg(gf-ga) OVER w,6) AS gdpg, round(avg(CASE WHEN gf=ga THEN 1.0 ELSE 0 END) OVER w,6) AS draw_rate FROM sides
WINDOW w AS (PARTITION BY season, team ORDER BY {DAY} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def season_to_date_ppg(spark, sf):
    w = windows.before_date(["season", "team"])
    return sides(fixtures(spark, sf)).select("match_id", "team", "is_home", r6(F.avg(F.expr(PTS)).over(w)).alias("ppg"), r6(F.avg(F.col("gf") - F.col("ga")).over(w)).alias("gdpg"), r6(F.avg(F.expr("CASE WHEN gf=ga THEN 1.0D ELSE 0D END")).over(w)).alias("draw_rate"))


@query(
    f"""WITH {SIDES} SELECT team, min(match_date) AS first_seen, max(match_date) AS last_seen, min(season) AS first_season, max(season) AS last_season, string_agg(DISTINCT league, '; ' ORDER BY league) AS leagues FROM sides GROUP BY team"""
)
def team_context(spark, sf):
    return sides(fixtures(spark, sf)).groupBy("team").agg(F.min("match_date").alias("first_seen"), F.max("match_date").alias("last_seen"), F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.array_join(F.sort_array(F.collect_set("league")), "; ").alias("leagues"))


EV = """v AS (SELECT event_id, user_id, date_trunc('hour', ts) AS ts, value FROM events WHERE event_type='view'), c AS (SELECT event_id AS c_id, user_id, date_trunc('hour', ts) AS cts, value AS c_value FROM events WHERE event_type='click')"""


def _events(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    v = e.where("event_type = 'view'").select("event_id", "user_id", "ts", "value")
    c = e.where("event_type = 'click'").select(F.col("event_id").alias("c_id"), "user_id", F.col("ts").alias("cts"), F.col("value").alias("c_value"))
    return v, c


def _asof_sql(op: str) -> str:
    return f"WITH {EV}, j AS (SELECT v.event_id, c.c_id, c.c_value, row_number() OVER (PARTITION BY v.event_id ORDER BY c.cts DESC NULLS LAST, c.c_id DESC) AS rn FROM v LEFT JOIN c ON c.user_id=v.user_id AND c.cts {op} v.ts) SELECT event_id, c_id, round(c_value,6) AS c_value FROM j WHERE rn=1"


@query(_asof_sql("<"))
def asof_strict(spark, sf):
    v, c = _events(spark, sf)
    return joins.asof(v, c, ["user_id"], "ts", "cts", ["c_id", "c_value"], True, ["c_id"]).select("event_id", "c_id", r6("c_value").alias("c_value"))


@query(_asof_sql("<="))
def asof_inclusive(spark, sf):
    v, c = _events(spark, sf)
    return joins.asof(v, c, ["user_id"], "ts", "cts", ["c_id", "c_value"], False, ["c_id"]).select("event_id", "c_id", r6("c_value").alias("c_value"))


@query(
    f"""WITH {EV}, j AS (SELECT v.event_id, v.ts, max(c.cts) AS m FROM v LEFT JOIN c ON c.user_id=v.user_id AND c.cts < v.ts GROUP BY 1,2)
SELECT CASE WHEN m IS NULL THEN 'none' WHEN ts-m <= INTERVAL 1 DAY THEN 'day' WHEN ts-m <= INTERVAL 7 DAY THEN 'week' ELSE 'older' END AS staleness, count(*) AS n FROM j GROUP BY 1"""
)
def asof_staleness(spark, sf):
    v, c = _events(spark, sf)
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("matched_ts").cast("timestamp"))
    bucket = F.when(age.isNull(), "none").when(age <= 86_400_000_000, "day").when(age <= 7 * 86_400_000_000, "week").otherwise("older")
    return joins.asof(v, c, ["user_id"], "ts", "cts", ["c_id"]).groupBy(bucket.alias("staleness")).agg(F.count(F.lit(1)).alias("n"))


SCD = """ch AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS valid_from FROM events WHERE event_type='signup'), iv AS (SELECT *, lead(valid_from) OVER (PARTITION BY user_id ORDER BY valid_from) AS valid_to FROM ch)"""


@query(
    f"""WITH {SCD}, j AS (SELECT e.event_id, iv.valid_from, iv.valid_to, row_number() OVER (PARTITION BY e.event_id ORDER BY (iv.valid_to IS NOT NULL) DESC, iv.valid_from DESC NULLS LAST) AS rn FROM events e LEFT JOIN iv ON iv.user_id=e.user_id AND iv.valid_from<=e.ts AND (iv.valid_to IS NULL OR e.ts<iv.valid_to) WHERE e.event_type='purchase')
SELECT event_id, CAST(valid_from AS DATE) AS valid_from, CAST(valid_to AS DATE) AS valid_to FROM j WHERE rn=1"""
)
def interval_join_scd(spark, sf):
    e = table(spark, sf, "events")
    changes = e.where("event_type = 'signup'").select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("valid_from")).distinct()
    iv = joins.change_intervals(changes, ["user_id"], "valid_from")
    out = joins.current_interval(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), iv, ["user_id"], "ts", "valid_from", "valid_to")
    return out.select("event_id", F.col("valid_from").cast("date").alias("valid_from"), F.col("valid_to").cast("date").alias("valid_to"))


@query(
    """WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type='view'), c AS (SELECT event_id AS c_id, user_id, ts AS cts FROM events WHERE event_type='click'),
j AS (SELECT v.event_id, c.c_id, count(*) OVER (PARTITION BY v.event_id) AS n FROM v JOIN c ON v.user_id=c.user_id AND abs(epoch_us(v.ts)-epoch_us(c.cts)) <= 108000000000) SELECT event_id, c_id FROM j WHERE n=1"""
)
def tolerance_join_unique(spark, sf):
    e = table(spark, sf, "events")
    v = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    c = e.where("event_type = 'click'").select(F.col("event_id").alias("c_id"), "user_id", F.col("ts").alias("cts"))
    return joins.tolerance_join(v, c, "user_id", "ts", "cts", 30 * 3600, "event_id").select("event_id", "c_id")


@query(
    """WITH o AS (SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS d FROM lineitem), l AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS e, l_extendedprice AS v FROM lineitem)
SELECT o.l_suppkey, o.d, count(*) AS n180, round(sum(v),2) AS value180, sum(CASE WHEN e >= d-30 THEN 1 ELSE 0 END)::BIGINT AS n30, round(max(v),2) AS biggest FROM o JOIN l ON o.l_suppkey=l.l_suppkey AND e<d AND e>=d-180 GROUP BY 1,2"""
)
def trailing_transfer_window(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("e"), F.col("l_extendedprice").alias("v"))  # noqa: E741
    o = l.select("l_suppkey", F.col("e").alias("d")).distinct()
    pairs = joins.trailing_join(o, l.select("l_suppkey", "e", "v"), "l_suppkey", "d", "e", 180)
    return pairs.groupBy("l_suppkey", "d").agg(F.count(F.lit(1)).alias("n180"), F.round(F.sum("v"), 2).alias("value180"), F.count_if(F.col("e") >= F.date_sub("d", 30)).alias("n30"), F.round(F.max("v"), 2).alias("biggest"))


@query(f"WITH {SIDES}, t AS (SELECT DISTINCT league, season, team FROM sides WHERE NOT (team % 4 = 0 AND season % 2 = 0)) SELECT league, season, team FROM t WHERE NOT EXISTS (SELECT 1 FROM t p WHERE p.league=t.league AND p.team=t.team AND p.season=t.season-1)")
def prior_season_antijoin(spark, sf):
    t = sides(fixtures(spark, sf)).where("NOT (team % 4 = 0 AND season % 2 = 0)").select("league", "season", "team").distinct()
    return t.join(t.withColumn("season", F.col("season") + 1), ["league", "season", "team"], "left_anti")


@query(f"WITH {FX} SELECT match_id, h.c_mktsegment AS home_segment, a.c_mktsegment AS away_segment, round(h.c_acctbal-a.c_acctbal,2) AS balance_gap FROM fx LEFT JOIN customer h ON h.c_custkey=home LEFT JOIN customer a ON a.c_custkey=away")
def dual_role_dims(spark, sf):
    dim = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("bal"))
    out = joins.dual_role(fixtures(spark, sf), dim, "c_custkey", {"home": "home", "away": "away"})
    return out.select("match_id", "home_segment", "away_segment", F.round(F.col("home_bal") - F.col("away_bal"), 2).alias("balance_gap"))


@query("SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON c_custkey=o_custkey LEFT JOIN nation ON n_nationkey=c_nationkey")
def validated_left_join(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return joins.validated_join(joins.validated_join(o, c, ["c_custkey"]), n, ["n_nationkey"]).select("o_orderkey", "c_mktsegment", "n_name")


@query(
    """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey%7<>0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey%11=0 THEN o_totalprice+1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey%5<>0)
SELECT CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' WHEN abs(a.v-b.v)<=1e-9 THEN 'both_equal' ELSE 'both_differ' END AS side, count(*) AS n FROM a FULL JOIN b ON a.k=b.k GROUP BY 1"""
)
def full_outer_replay_diff(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = o.where("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 11 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return joins.replay_diff(o.where("k % 7 <> 0"), b, ["k"], "v").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice > 300000)")
def semi_isin(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey)")
def anti_new_rows(spark, sf):
    seen = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(
    f"""WITH {SIDES}, p AS (SELECT season+1 AS season, team, sum({PTS})::BIGINT AS points, round(avg(gf),6) AS gf FROM sides GROUP BY 1,2)
SELECT DISTINCT s.season, s.team, p.points AS prior_points, p.gf AS prior_gf FROM sides s LEFT JOIN p USING (season, team)"""
)
def prior_season_profile(spark, sf):
    s = sides(fixtures(spark, sf))
    p = s.groupBy((F.col("season") + 1).alias("season"), "team").agg(F.sum(F.expr(PTS)).alias("prior_points"), r6(F.avg("gf")).alias("prior_gf"))
    return s.select("season", "team").distinct().join(p, ["season", "team"], "left")
