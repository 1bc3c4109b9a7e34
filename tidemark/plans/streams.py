"""Replay, ledger, state, model and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models, replay, state
from ..sources import readers, sinks
from .base import FX, fixtures, query, r6, table
from .scalars import SETTLE

S = "s AS (SELECT user_id AS market, event_type AS runner, ts, event_id AS pos, 1+value/100 AS price, event_type='error' AS in_play FROM events)"


def _stream(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("market"), F.col("event_type").alias("runner"), "ts", F.col("event_id").alias("pos"), (1 + F.col("value") / 100).alias("price"), (F.col("event_type") == "error").alias("in_play"))


@query(
    f"""WITH {S}, p AS (SELECT * FROM s WHERE price>1 AND runner IN ('view','click','purchase')), c AS (SELECT DISTINCT market, TIMESTAMP '2024-01-10' + INTERVAL (k*5) DAY AS cutoff FROM p, (SELECT unnest([0,1,2]) AS k)), g AS (SELECT c.*, r.runner FROM c JOIN (SELECT DISTINCT market, runner FROM p) r USING (market)),
j AS (SELECT g.market, g.cutoff, g.runner, p.price, p.ts, row_number() OVER (PARTITION BY g.market, g.cutoff, g.runner ORDER BY p.ts DESC, p.pos DESC) AS rn FROM g JOIN p ON p.market=g.market AND p.runner=g.runner AND p.ts<=g.cutoff),
f AS (SELECT *, count(*) OVER (PARTITION BY market, cutoff) AS n FROM j WHERE rn=1) SELECT market, CAST(cutoff AS DATE) AS cutoff, runner, round(price,6) AS price, round((epoch_us(cutoff)-epoch_us(ts))/1000000.0,3)::DOUBLE AS age_s FROM f WHERE n=3"""
)
def ltp_cutoff_panel(spark, sf):
    s = _stream(spark, sf).where(F.col("runner").isin("view", "click", "purchase") & (F.col("price") > 1))
    cut = F.array(*[F.lit(d).cast("timestamp_ntz") for d in ("2024-01-10", "2024-01-15", "2024-01-20")])
    cutoffs = s.select("market").distinct().select("market", F.explode(cut).alias("cutoff"))
    return replay.cutoff_panel(s, cutoffs, 3).select("market", F.col("cutoff").cast("date").alias("cutoff"), "runner", r6("price").alias("price"), F.round("age_s", 3).alias("age_s"))


PLAY = f"{S}, e AS (SELECT *, last_value(in_play) OVER (PARTITION BY market ORDER BY ts, pos) AS p FROM s)"


@query(f"WITH {PLAY}, r AS (SELECT *, row_number() OVER (PARTITION BY market, runner ORDER BY ts DESC, pos DESC) AS rn FROM e WHERE NOT p AND price>1) SELECT market, runner, round(price,6) AS price FROM r WHERE rn=1")
def ltp_last_preplay(spark, sf):
    return replay.last_preplay(_stream(spark, sf)).select("market", "runner", r6("price").alias("price"))


@query(f"WITH {PLAY} SELECT market, count(*) AS updates, sum(CASE WHEN NOT p THEN 1 ELSE 0 END)::BIGINT AS eligible FROM e GROUP BY 1")
def inplay_exclusion(spark, sf):
    s = _stream(spark, sf)
    ok = replay.eligible(s).groupBy("market").agg(F.count(F.lit(1)).alias("eligible"))
    return s.groupBy("market").agg(F.count(F.lit(1)).alias("updates")).join(ok, "market", "left").select("market", "updates", F.coalesce("eligible", F.lit(0)).alias("eligible"))


@query(
    f"""WITH {S}, d AS (SELECT *, price - lag(price) OVER w AS change FROM s WINDOW w AS (PARTITION BY market ORDER BY ts, pos))
SELECT pos AS event_id, round(change,6) AS change, round(stddev_pop(change) OVER w,5) AS volatility, round(max(price) OVER w - min(price) OVER w,6) AS range, round(max(price) OVER w - price,6) AS below_high, count(price) OVER w - 1 AS n_before FROM d WINDOW w AS (PARTITION BY market ORDER BY ts, pos ROWS UNBOUNDED PRECEDING)"""
)
def path_features(spark, sf):
    p = replay.path_features(_stream(spark, sf), ["market"])
    return p.select(F.col("pos").alias("event_id"), r6("change").alias("change"), (F.round("volatility", 5) + F.lit(0.0)).alias("volatility"), r6("range").alias("range"), r6("below_high").alias("below_high"), "n_before")


@query(
    """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid"""
)
def event_sessions(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value),4) AS value FROM events GROUP BY 1,2")
def event_tumbling(spark, sf):
    e = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "value")


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props,'$.k') AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY 1")
def json_props(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.from_json("props", "k bigint")["k"]).alias("k_sum"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey%2=0 OR o_orderkey%3=0")
def ledger_append(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    once = sinks.append_new(o.where("id % 2 = 0"), o.where("id % 3 = 0"), "id")
    return sinks.append_new(once, o.where("id % 3 = 0"), "id")


@query(
    f"""WITH {SETTLE} SELECT CASE WHEN match_id%5=0 THEN 'OPEN' ELSE 'SETTLED_' || upper(label) END AS status, count(*) AS n, round(coalesce(sum(CASE WHEN match_id%5<>0 THEN profit END),0),6) AS profit FROM s GROUP BY 1"""
)
def ledger_settle(spark, sf):
    fx = fixtures(spark, sf)
    ledger = fx.select(F.col("match_id").alias("id"), F.col("ah_line").alias("line"), F.col("odds_h").alias("odds"), F.lit("OPEN").alias("status"), F.lit(None).cast("double").alias("profit"))
    results = fx.where("match_id % 5 <> 0").select(F.col("match_id").alias("id"), (F.col("hg") - F.col("ag")).alias("margin"))
    return sinks.settle(ledger, results, "id").groupBy("status").agg(F.count(F.lit(1)).alias("n"), r6(F.coalesce(F.sum("profit"), F.lit(0.0))).alias("profit"))


@query(f"WITH {FX}, n AS (SELECT DISTINCT league, match_date FROM fx WHERE month(match_date)<>5), c AS (SELECT DISTINCT league, match_date FROM fx WHERE season<1999) SELECT league, min(match_date) AS from_date, max(match_date) AS to_date, count(*) AS n_dates FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.league=n.league AND c.match_date=n.match_date) GROUP BY 1")
def request_plan(spark, sf):
    fx = fixtures(spark, sf)
    return readers.request_plan(fx.where(F.month("match_date") != 5), fx.where("season < 1999").select("league", "match_date").distinct(), "league", "match_date")


@query(
    """WITH m AS (SELECT vec_id, embedding::DOUBLE[] e, label FROM embeddings), s AS (SELECT q.vec_id, m.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e,m.e),9) DESC, m.vec_id) AS rn FROM m q, m WHERE q.vec_id<>m.vec_id)
SELECT vec_id, round(avg(label),6) AS memory_value FROM s WHERE rn<=5 GROUP BY 1"""
)
def knn_memory(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("double").alias("value"))
    out = models.memory_values(e, e, 5)
    return out.select(F.col("id").alias("vec_id"), r6("memory_value").alias("memory_value"))


@query(f"WITH {FX}, h AS (SELECT regr_slope(hg-ag, odds_a-odds_h) AS slope, regr_intercept(hg-ag, odds_a-odds_h) AS intercept FROM fx) SELECT round(slope,6) AS slope, round(intercept,6) AS intercept FROM h")
def affine_calibration(spark, sf):
    fx = fixtures(spark, sf).select((F.col("hg") - F.col("ag")).cast("double").alias("y"), (F.col("odds_a") - F.col("odds_h")).alias("x"))
    return models.affine_calibration(fx, "x", "y").select(r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query()
def elo_ratings(spark, sf):
    return state.elo(fixtures(spark, sf)).withColumns({c: r6(c) for c in ("home_elo_pre", "away_elo_pre", "p_home")})


@query()
def dynamic_scoreline(spark, sf):
    return state.scoreline(fixtures(spark, sf)).withColumns({c: r6(c) for c in ("rate_home", "rate_away", "uncertainty")})


@query()
def ml_logistic(spark, sf):
    fx = fixtures(spark, sf).withColumn("y", (F.col("hg") > F.col("ag")).cast("double"))
    features = ["odds_h", "odds_d", "odds_a", "ah_line"]
    model = models.logistic(features, "y").fit(fx.where("season < 1998"))
    return models.scored(model, fx.where("season = 1998")).select("match_id", r6("p").alias("p"))


@query("SELECT length(text) - length(replace(text,' ','')) + 1 AS n_spaces, count(*) AS n FROM benchmark GROUP BY 1")
def text_profile(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.groupBy((F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_spaces")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT user_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_type FROM events")
def first_message(spark, sf):
    return readers.first_messages(table(spark, sf, "events"), "user_id", ["ts", "event_id"], 1).select("user_id", F.col("event_type").alias("first_type"))
