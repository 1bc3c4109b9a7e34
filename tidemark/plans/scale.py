"""The forms of joins and scans for keys that hold much of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..sources import readers
from .base import FX, fixtures, query, r6, table
from .temporal import EV, _events



def _shops(spark, sf):
    """Views and clicks of three shops, one of which has most."""
    v, c = _events(spark, sf)
    shop = lambda d: d.withColumn("shop", F.when(F.col("user_id") % 5 < 3, 0).otherwise(F.col("user_id") % 5)).drop("user_id")
    return shop(v), shop(c)


def _spans_sql(op: str) -> str:
    pick = "CASE WHEN user_id%5<3 THEN 0 ELSE user_id%5 END AS shop"
    return f"WITH {EV.replace('v AS', 'v0 AS', 1).replace('c AS', 'c0 AS', 1)}, v AS (SELECT *, {pick} FROM v0), c AS (SELECT *, {pick} FROM c0), c1 AS (SELECT shop, cts, arg_max(c_id, c_id) AS c_id, arg_max(c_value, c_id) AS c_value FROM c GROUP BY ALL) SELECT event_id, c_id, round(c_value,6) AS c_value FROM v ASOF LEFT JOIN c1 ON v.shop=c1.shop AND v.ts {op} c1.cts"


@query(_spans_sql(">"))
def asof_hot_key(spark, sf):
    v, c = _shops(spark, sf)
    return joins.asof_spans(v, c, ["shop"], "ts", "cts", ["c_id", "c_value"], 7 * 86_400, True, ["c_id"]).select("event_id", "c_id", r6("c_value").alias("c_value"))


@query(_spans_sql(">="))
def asof_hot_key_inclusive(spark, sf):
    v, c = _shops(spark, sf)
    return joins.asof_spans(v, c, ["shop"], "ts", "cts", ["c_id", "c_value"], 7 * 86_400, False, ["c_id"]).select("event_id", "c_id", r6("c_value").alias("c_value"))


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn<=5")
def first_five_messages(spark, sf):
    return readers.first_messages(table(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], 5)


@query(
    f"""WITH {FX}, a AS (SELECT match_id AS id, home, away, epoch(match_date) AS t, CASE WHEN home<away THEN home || '-' || away ELSE away || '-' || home END AS k FROM fx WHERE match_id%3=0),
b AS (SELECT match_id AS other, home AS h2, epoch(match_date) AS t2, CASE WHEN home<away THEN home || '-' || away ELSE away || '-' || home END AS k FROM fx WHERE match_id%3<>0),
j AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, count(*) OVER (PARTITION BY other) AS m FROM a JOIN b USING (k) WHERE abs(t-t2)<=1209600) SELECT id, other, h2<>home AS swapped FROM j WHERE n=1 AND m=1"""
)
def pair_tolerance_unique(spark, sf):
    fx = fixtures(spark, sf).select("match_id", "home", "away", F.col("match_date").cast("timestamp").alias("at"))
    left, right = fx.where("match_id % 3 = 0").withColumnRenamed("match_id", "id"), fx.where("match_id % 3 <> 0").withColumnsRenamed({"match_id": "other", "at": "at2"})
    return joins.pair_tolerance_join(left, right, ("home", "away"), "at", "at2", 1_209_600, "id", "other").select("id", "other", "swapped")
