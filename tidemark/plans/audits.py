"""Inventories, duplicates, anomalies, mapping and settlement audits."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import market
from ..operators import anomalies, contracts, identity, joins, replay
from ..sources import sinks
from .base import FX, fixtures, query, r6, table
from .scalars import SETTLE, margin, settled
from .streams import S, _stream


@query(
    f"""WITH {FX}, c AS (SELECT league, unnest(['odds_h','odds_d','odds_a']) AS col, unnest([CASE WHEN match_id%9=0 THEN NULL ELSE odds_h-0.5 END, odds_d, odds_a-0.5]) AS v FROM fx)
SELECT league, col AS "column", count(*) AS match_rows, count(v) AS non_null_values, sum(CASE WHEN v>1 THEN 1 ELSE 0 END)::BIGINT AS valid_odds_values, sum(CASE WHEN v<=1 THEN 1 ELSE 0 END)::BIGINT AS invalid_odds_le_1, round(sum(CASE WHEN v>1 THEN 1.0 ELSE 0 END)/count(*),6) AS valid_odds_coverage, round(min(v),6) AS min_value, round(max(v),6) AS max_value FROM c GROUP BY 1,2"""
)
def odds_inventory(spark, sf):
    fx = fixtures(spark, sf).select("league", F.when(F.col("match_id") % 9 != 0, F.col("odds_h") - 0.5).alias("odds_h"), "odds_d", (F.col("odds_a") - 0.5).alias("odds_a"))
    out = contracts.odds_inventory(fx, ["league"], ["odds_h", "odds_d", "odds_a"])
    return out.withColumns({c: r6(c) for c in ("valid_odds_coverage", "min_value", "max_value")})


@query(f"WITH {FX}, u AS (SELECT odds_h, ah_line, NULL::DOUBLE AS nothing, 7.0 AS constant, CASE WHEN match_id>0 THEN season END AS season, CASE WHEN season=1998 THEN odds_d END AS late FROM fx) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c})>1 AS usable FROM u" for c in ("odds_h", "ah_line", "nothing", "constant", "season", "late")))
def usable_features(spark, sf):
    fx = fixtures(spark, sf).select("odds_h", "ah_line", F.lit(None).cast("double").alias("nothing"), F.lit(7.0).alias("constant"), "season", F.when(F.col("season") == 1998, F.col("odds_d")).alias("late"))
    return contracts.usable(fx, fx.columns)


KEYS = {"order_supplier": ["l_orderkey", "l_suppkey"], "order_part": ["l_orderkey", "l_partkey"], "order_part_price": ["l_orderkey", "l_partkey", "l_extendedprice"]}


@query(" UNION ALL ".join(f"SELECT '{k}' AS duplicate_key_type, count(*) AS keys, sum(n)::BIGINT AS rows, sum(d)::BIGINT AS dates FROM (SELECT {', '.join(c)}, count(*) AS n, count(DISTINCT l_shipdate) AS d FROM lineitem GROUP BY {', '.join(c)} HAVING count(*)>1) HAVING count(*)>0" for k, c in KEYS.items()))
def loose_duplicates(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    out = None
    for name, keys in KEYS.items():
        own = identity.loose_duplicates(l, name, keys, "l_shipdate").groupBy("duplicate_key_type").agg(F.count(F.lit(1)).alias("keys"), F.sum("rows").alias("rows"), F.sum("unique_dates").alias("dates"))
        out = own if out is None else out.unionByName(own)
    return out


@query(
    f"""WITH {SETTLE}, x AS (SELECT match_id, league, season, label, profit, match_id%6=0 AS missing, CASE WHEN a+b>0 THEN 1 WHEN a+b<0 THEN 0 END AS before, hg-ag+ah_line AS m FROM s)
SELECT league, season, count(*) AS matches, sum(CASE WHEN missing THEN 0 ELSE 1 END)::BIGINT AS valid_rows, round(avg(CASE WHEN NOT missing AND label='full_win' THEN 1.0 ELSE 0 END),6) AS full_win_rate, round(avg(CASE WHEN NOT missing AND label='push' THEN 1.0 ELSE 0 END),6) AS push_rate, round(avg(CASE WHEN NOT missing AND label='half_loss' THEN 1.0 ELSE 0 END),6) AS half_loss_rate,
round(avg(CASE WHEN NOT missing THEN profit END),6) AS average_profit, sum(CASE WHEN NOT missing AND label='push' THEN 1 ELSE 0 END)::BIGINT AS pushes, sum(CASE WHEN NOT missing AND label<>'push' AND (label IN ('full_win','half_win'))<>(m>0) THEN 1 ELSE 0 END)::BIGINT AS mismatches FROM x GROUP BY 1,2"""
)
def settlement_audit(spark, sf):
    fx = fixtures(spark, sf).withColumn("odds_h", F.when(F.col("match_id") % 6 != 0, F.col("odds_h")))
    s = settled(fx)
    ok = F.col("label") != "invalid"
    rate = lambda v: r6(F.avg((F.col("label") == v).cast("double")))
    cover = F.col("label").isin("full_win", "half_win")
    differ = ok & (F.col("label") != "push") & (cover != (margin() + F.col("ah_line") > 0))
    return s.groupBy("league", "season").agg(F.count(F.lit(1)).alias("matches"), F.count_if(ok).alias("valid_rows"), rate("full_win").alias("full_win_rate"), rate("push").alias("push_rate"), rate("half_loss").alias("half_loss_rate"), r6(F.avg("profit")).alias("average_profit"), F.count_if(F.col("label") == "push").alias("pushes"), F.count_if(differ).alias("mismatches"))


@query(
    "WITH d AS (SELECT n_nationkey, CASE n_nationkey%5 WHEN 0 THEN 'approved_obvious_alias' WHEN 1 THEN 'rejected' ELSE 'candidate' END AS s FROM nation) SELECT s AS alias_status, (s='approved_obvious_alias') AS approved, count(*) AS n FROM d GROUP BY 1,2"
)
def alias_decisions(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("alias_id"), F.col("n_name").alias("alias_name"), F.col("n_regionkey").alias("team_id"), F.lit("candidate").alias("alias_status"), F.lit(False).alias("approved"))
    made = n.where("alias_id % 5 < 2").select("alias_id", "alias_name", "team_id", F.when(F.col("alias_id") % 5 == 0, "approved").otherwise("rejected").alias("decision"))
    return identity.apply_decisions(n, made).groupBy("alias_status", "approved").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FX} SELECT match_id, CASE WHEN match_id%5=4 THEN NULL ELSE 'T' || CASE WHEN match_id%2=0 THEN home ELSE away END END AS first, CASE WHEN match_id%5=4 THEN NULL ELSE 'T' || CASE WHEN match_id%2=0 THEN away ELSE home END END AS second, match_id%5<>4 AS supported FROM fx")
def event_names(spark, sf):
    m = F.col("match_id")
    a, b = (F.concat(F.lit("T"), F.when(m % 2 == 0, F.col(x)).otherwise(F.col(y)).cast("string")) for x, y in (("home", "away"), ("away", "home")))
    mark = F.element_at(F.array(*map(F.lit, [" v ", " VS ", " @ ", " - ", "-"])), (m % 5 + 1).cast("int"))
    fx = fixtures(spark, sf).select("match_id", "home", "away", identity.split_event(F.concat(a, mark, b)).alias("p"))
    names = F.array_sort(F.array(*[F.concat(F.lit("T"), F.col(c).cast("string")) for c in ("home", "away")]))
    return fx.select("match_id", F.col("p")[0].alias("first"), F.col("p")[1].alias("second"), F.coalesce(F.array_sort("p") == names, F.lit(False)).alias("supported"))


@query(f"WITH {FX} SELECT match_id, CASE WHEN match_id%7=0 THEN NULL ELSE home+100 END AS home_runner, CASE WHEN match_id%7=0 THEN NULL ELSE away+100 END AS away_runner, CASE WHEN match_id%7=0 THEN NULL ELSE 58805 END AS draw_runner FROM fx")
def runner_orientation(spark, sf):
    runner = lambda n, i: F.struct(n.cast("string").alias("n"), i.alias("i"))
    h, a, d = runner(F.col("home"), F.col("home") + 100), runner(F.col("away"), F.col("away") + 100), runner(F.when(F.col("match_id") % 7 != 0, "draw").otherwise("other"), F.lit(58805))
    turn = F.col("match_id") % 3
    rs = F.when(turn == 0, F.array(h, a, d)).when(turn == 1, F.array(d, a, h)).otherwise(F.array(a, d, h))
    fx = fixtures(spark, sf).withColumn("rs", rs)
    o = identity.orientation(F.col("rs.n"), F.col("rs.i"), F.col("home").cast("string"), F.col("away").cast("string"))
    return fx.select("match_id", o.alias("o")).select("match_id", F.col("o.home").alias("home_runner"), F.col("o.away").alias("away_runner"), F.col("o.draw").alias("draw_runner"))


STATUS = {"approved": "match_id%11=0", "eligible": "match_id%4", "candidate": "match_id%3=0", "near": "match_id%5", "far": "match_id%6", "duplicate": "match_id%7=0", "kind": "CASE WHEN match_id%8=0 THEN 'OVER_UNDER' ELSE 'MATCH_ODDS' END", "runners": "2+match_id%2", "draws": "1", "state": "CASE WHEN match_id%13=0 THEN 'CLOSED' ELSE 'OPEN' END", "any_team": "match_id%2=0"}


@query(
    f"""WITH {FX}, m AS (SELECT match_id, {', '.join(f'{v} AS {k}' for k, v in STATUS.items())} FROM fx)
SELECT CASE WHEN approved THEN 'mapped_approved' WHEN eligible=1 AND candidate THEN 'team_alias_unresolved' WHEN eligible>1 THEN 'multiple_candidate_markets' WHEN far>0 AND near=0 THEN 'date_mismatch' WHEN near>0 AND duplicate THEN 'duplicate_market' WHEN near>0 AND kind<>'MATCH_ODDS' THEN 'non_match_odds'
WHEN near>0 AND runners<>3 THEN 'incomplete_runners' WHEN near>0 AND state<>'OPEN' THEN 'market_cancelled_or_invalid' WHEN near>0 THEN 'home_away_orientation_unresolved' WHEN any_team THEN 'team_alias_unresolved' ELSE 'no_betfair_candidate' END AS status, count(*) AS n FROM m GROUP BY 1"""
)
def mapping_status(spark, sf):
    fx = fixtures(spark, sf).select(*[F.expr(v).alias(k) for k, v in STATUS.items()])
    order = ("approved", "eligible", "candidate", "near", "far", "duplicate", "kind", "runners", "draws", "state", "any_team")
    return fx.groupBy(identity.mapping_status(*[F.col(c) for c in order]).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {FX}, t AS (SELECT DISTINCT league, home AS team FROM fx), m AS (SELECT league, team FROM t WHERE team%3=0) SELECT m.league, m.team, count(*) AS fixture_rows_impacted, sum(CASE WHEN season BETWEEN 1996 AND 1998 THEN 1 ELSE 0 END)::BIGINT AS test_rows_impacted FROM m JOIN fx ON fx.league=m.league AND (fx.home=m.team OR fx.away=m.team) GROUP BY 1,2"""
)
def alias_impact(spark, sf):
    fx = fixtures(spark, sf)
    missing = fx.select("league", F.col("home").alias("team")).where("team % 3 = 0").distinct()
    both = fx.select("league", "season", F.explode(F.array_distinct(F.array("home", "away"))).alias("team"))
    hit = both.join(missing, ["league", "team"], "left_semi")
    return hit.groupBy("league", "team").agg(F.count(F.lit(1)).alias("fixture_rows_impacted"), F.count_if(F.col("season").between(1996, 1998)).alias("test_rows_impacted"))


CAND = "SELECT league, season, home AS team, (home*3+match_id)%6 AS candidate, max(0.6+CAST((match_id*7)%41 AS DOUBLE)/100) AS score FROM fx GROUP BY 1,2,3,4"


@query(
    f"""WITH {FX}, c AS (SELECT *, score>=0.99 AS exact, candidate<>5 AS same FROM ({CAND})), v AS (SELECT league, season, home AS team, (home*3+match_id)%6 AS candidate, count(*) AS n FROM fx WHERE match_id%5=0 GROUP BY 1,2,3,4),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second, max(score) OVER (PARTITION BY league, season, team) AS top FROM c WINDOW w AS (PARTITION BY league, season, team ORDER BY score DESC, candidate)),
k AS (SELECT league, season, team, sum(CASE WHEN score>=greatest(0.80,top-0.05) THEN 1 ELSE 0 END)-1 AS competing FROM r GROUP BY 1,2,3), b AS (SELECT r.*, competing, coalesce(v.n,0) AS support FROM r JOIN k USING (league, season, team) LEFT JOIN v USING (league, season, team, candidate) WHERE rn=1),
s AS (SELECT league, team, candidate, count(DISTINCT season) AS seasons FROM b GROUP BY 1,2,3), x AS (SELECT b.*, seasons, same::INT+exact::INT+(score>=0.86)::INT+(support>=2)::INT+(competing=0 AND score-coalesce(second,0)>=0.04)::INT+(seasons>=2)::INT AS signals FROM b JOIN s USING (league, team, candidate)),
d AS (SELECT *, CASE WHEN NOT same THEN 'rejected_wrong_country_or_competition' WHEN exact AND competing=0 THEN 'approved_exact' WHEN competing>0 AND support<2 THEN 'rejected_ambiguous' WHEN score<0.68 AND support<2 THEN 'rejected_low_similarity' WHEN (score>=0.86 AND signals>=3 AND competing=0) OR (support>=3 AND score>=0.72 AND competing=0) THEN 'approved_high_confidence_alias' ELSE 'manual_review_required' END AS dec FROM x),
e AS (SELECT *, sum(CASE WHEN dec LIKE 'approved%' THEN 1 ELSE 0 END) OVER (PARTITION BY league, season, candidate) AS sharing FROM d)
SELECT league, season, team, candidate, CASE WHEN dec LIKE 'approved%' AND sharing>1 THEN 'manual_review_required' ELSE dec END AS decision FROM e"""
)
def candidate_decisions(spark, sf):
    fx = fixtures(spark, sf).withColumn("team", F.col("home")).withColumn("candidate", (F.col("home") * 3 + F.col("match_id")) % 6)
    keys = ["league", "season", "team"]
    c = fx.groupBy(*keys, "candidate").agg(F.max(F.expr("0.6D+double((match_id*7)%41)/100")).alias("score"))
    c = c.withColumn("exact", F.col("score") >= 0.99).withColumn("same_competition", F.col("candidate") != 5)
    support = fx.where("match_id % 5 = 0").groupBy(*keys, "candidate").agg(F.count(F.lit(1)).alias("n"))
    return identity.candidate_decisions(c, keys, support).select(*keys, "candidate", "decision")


@query(
    f"""WITH {FX}, g AS (SELECT DISTINCT match_date, least(home,away)+100 AS a, greatest(home,away)+100 AS b FROM fx WHERE match_id%3<>0), m AS (SELECT * FROM fx WHERE home%4<>1 AND away%4<>1), e AS (SELECT m.home, m.away FROM m JOIN g ON g.match_date=m.match_date AND g.a=least(home,away)+100 AND g.b=greatest(home,away)+100)
SELECT team, (team+100)::INT AS id, count(*) AS n FROM (SELECT home AS team FROM e UNION ALL SELECT away FROM e) GROUP BY 1"""
)
def fixture_evidence(spark, sf):
    fx = fixtures(spark, sf)
    games = fx.where("match_id % 3 <> 0").select("match_date", (F.col("away") + 100).alias("home_id"), (F.col("home") + 100).alias("away_id"))
    mapping = fx.select(F.explode(F.array("home", "away")).alias("team")).distinct().where("team % 4 <> 1").select("team", (F.col("team") + 100).alias("id"))
    return joins.evidence(fx.select("match_date", "home", "away"), games, ["match_date"], mapping)


@query(
    f"""WITH {S}, p AS (SELECT * FROM s WHERE price>1 AND runner IN ('view','click','purchase')), c AS (SELECT DISTINCT market, TIMESTAMP '2024-01-15' AS cutoff FROM p), j AS (SELECT c.market, c.cutoff, p.runner, p.price, p.ts, row_number() OVER (PARTITION BY c.market, p.runner ORDER BY p.ts DESC, p.pos DESC) AS rn FROM c JOIN p ON p.market=c.market AND p.ts<=c.cutoff),
f AS (SELECT *, count(*) OVER (PARTITION BY market) AS n FROM j WHERE rn=1), x AS (SELECT *, epoch_us(cutoff)-epoch_us(ts) AS age, CASE WHEN market%2=0 THEN TIMESTAMP '2024-01-15 00:00:01' ELSE TIMESTAMP '2024-01-14' END AS start FROM f WHERE n=3),
y AS (SELECT 'prices_above_one' AS "check", count_if(NOT price>1) AS v FROM x UNION ALL SELECT 'nonnegative_staleness', count_if(age<0) FROM x UNION ALL SELECT 'strictly_before_start', count_if(cutoff>=start) FROM x UNION ALL SELECT 'older_than_ten_days', count_if(age>864000000000) FROM x)
SELECT "check", CASE WHEN v=0 THEN 'pass' ELSE 'fail' END AS status, v::BIGINT AS violations FROM y"""
)
def cutoff_audit(spark, sf):
    s = _stream(spark, sf).where(F.col("runner").isin("view", "click", "purchase") & (F.col("price") > 1))
    cutoffs = s.select("market").distinct().select("market", F.lit("2024-01-15").cast("timestamp_ntz").alias("cutoff"))
    panel = replay.cutoff_panel(s, cutoffs, 3).withColumn("start", F.when(F.col("market") % 2 == 0, "2024-01-15 00:00:01").otherwise("2024-01-14").cast("timestamp_ntz"))
    return replay.cutoff_audit(panel, {"older_than_ten_days": F.col("age_s") > 864000})


@query(f"WITH {FX} SELECT 'same_teams' AS anomaly, sum(CASE WHEN home=away THEN 1 ELSE 0 END)::BIGINT AS n FROM fx UNION ALL SELECT 'odds_sum_below_one', sum(CASE WHEN 1/odds_h+1/odds_d+1/odds_a<1 THEN 1 ELSE 0 END)::BIGINT FROM fx UNION ALL SELECT 'line_off_quarter', sum(CASE WHEN abs(ah_line*4-round(ah_line*4))>1e-8 OR abs(ah_line)>10 THEN 1 ELSE 0 END)::BIGINT FROM fx UNION ALL SELECT 'goals_above_three', sum(CASE WHEN hg>3 THEN 1 ELSE 0 END)::BIGINT FROM fx")
def fixture_anomalies(spark, sf):
    bad = {"same_teams": F.col("home") == F.col("away"), "odds_sum_below_one": market.overround([F.col(c) for c in ("odds_h", "odds_d", "odds_a")]) < 0, "line_off_quarter": (F.abs(F.col("ah_line") * 4 - F.round(F.col("ah_line") * 4)) > 1e-8) | (F.abs("ah_line") > 10), "goals_above_three": F.col("hg") > 3}
    one = fixtures(spark, sf).agg(*[F.count_if(c).alias(k) for k, c in bad.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("anomaly"), F.col(k).alias("n")) for k in bad])))


_BOOKS = "CASE match_id%4 WHEN 0 THEN 'alpha' WHEN 1 THEN CASE WHEN season%2=0 THEN 'beta' ELSE 'alpha' END WHEN 2 THEN CASE WHEN season>=1996 THEN 'gamma' ELSE 'alpha' END ELSE CASE WHEN season%3=0 THEN 'delta' END END"


@query(
    f"""WITH {FX}, x AS (SELECT *, 'file' || match_id%3 AS file, {_BOOKS} AS book, match_id%7<>0 AS opening, match_id%5<>0 AS closing FROM fx),
c AS (SELECT league || '|' || match_date || '|' || home AS place, count(*) AS n, count(DISTINCT (hg, ag)) AS k, string_agg(DISTINCT file, '|' ORDER BY file) AS files FROM x GROUP BY ALL HAVING count(DISTINCT (hg, ag))>1),
m AS (SELECT book AS place, count(DISTINCT season%2) AS k FROM x WHERE book IS NOT NULL GROUP BY 1 HAVING count(DISTINCT season%2)>1),
s AS (SELECT league, season, dense_rank() OVER (PARTITION BY league ORDER BY season) AS k, list(DISTINCT book) AS now FROM x WHERE book IS NOT NULL GROUP BY 1,2),
d AS (SELECT b.league || '|' || b.season AS place, len(list_filter(b.now, lambda v: NOT list_contains(a.now, v))) AS came, len(list_filter(a.now, lambda v: NOT list_contains(b.now, v))) AS went FROM s a JOIN s b ON a.league=b.league AND b.k=a.k+1),
o AS (SELECT league || '|' || season AS place, count_if(closing AND NOT opening) AS c, count_if(opening AND NOT closing) AS o FROM x GROUP BY 1)
SELECT 'inconsistent_score_rows' AS anomaly, 'error' AS severity, place, n::BIGINT AS affected_rows, k || ' scores in ' || files AS details FROM c UNION ALL SELECT 'column_meaning_changed', 'blocker', place, k::BIGINT, '' FROM m
UNION ALL SELECT 'members_appeared_or_disappeared', 'info', place, (came+went)::BIGINT, '+' || came || ' -' || went FROM d WHERE came+went>0 UNION ALL SELECT 'closing_without_opening', 'blocker', place, c::BIGINT, '' FROM o WHERE c>0 UNION ALL SELECT 'opening_without_closing', 'warning', place, o::BIGINT, '' FROM o WHERE o>0"""
)
def cross_file_anomalies(spark, sf):
    m = F.col("match_id")
    x = fixtures(spark, sf).withColumn("file", F.concat(F.lit("file"), (m % 3).cast("string"))).withColumn("book", F.expr(_BOOKS)).withColumn("half", F.col("season") % 2)
    parts = [
        anomalies.score_conflicts(x, ["league", "match_date", "home"], ["hg", "ag"], "file"),
        anomalies.meaning_changes(x.where("book IS NOT NULL"), ["book"], ["half"]),
        anomalies.members_changed(x, "league", "season", "book"),
        anomalies.one_sided(x, ["league", "season"], m % 7 != 0, m % 5 != 0),
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query(f"""WITH {SETTLE}, l AS (SELECT CASE WHEN match_id%5=0 THEN 'OPEN' ELSE 'SETTLED' END AS status, profit FROM s) SELECT count(*) AS rows, sum(CASE WHEN status='OPEN' THEN 1 ELSE 0 END)::BIGINT AS open, sum(CASE WHEN status<>'OPEN' THEN 1 ELSE 0 END)::BIGINT AS settled, round(sum(CASE WHEN status<>'OPEN' THEN profit END),6) AS profit, round(avg(CASE WHEN status<>'OPEN' THEN CASE WHEN profit>0 THEN 1.0 ELSE 0 END END),6) AS win_rate FROM l""")
def ledger_performance(spark, sf):
    fx = fixtures(spark, sf)
    ledger = fx.select(F.col("match_id").alias("id"), F.col("ah_line").alias("line"), F.col("odds_h").alias("odds"), F.lit("OPEN").alias("status"), F.lit(None).cast("double").alias("profit"))
    done = sinks.settle(ledger, fx.where("match_id % 5 <> 0").select(F.col("match_id").alias("id"), margin().alias("margin")), "id")
    return sinks.performance(done).select("rows", "open", "settled", r6("profit").alias("profit"), r6("win_rate").alias("win_rate"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey%3<>0 OR o_orderstatus='P'")
def resume_pending(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    done = o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderstatus")
    return sinks.pending(o, done, "o_orderkey", again=F.col("o_orderstatus") == "P")


@query(
    f"""WITH {FX}, d AS (SELECT DISTINCT match_date FROM fx), r AS (SELECT match_date, row_number() OVER (ORDER BY match_date) - 1 AS i, count(*) OVER () AS n FROM d), b AS (SELECT k, (SELECT any_value(n) FROM r) AS n, (k*((SELECT any_value(n) FROM r)//3) + least(k, (SELECT any_value(n) FROM r)%3)) AS lo, ((SELECT any_value(n) FROM r)//3 + CASE WHEN k < (SELECT any_value(n) FROM r)%3 THEN 1 ELSE 0 END) AS size FROM (SELECT unnest([0,1,2]) AS k)),
p AS (SELECT k, j, lo + ((size-1)*j)//9 AS i FROM b, (SELECT unnest(range(10)) AS j)) SELECT (p.k+1)::INT AS third, (p.j+1)::INT AS place, r.match_date FROM p JOIN r USING (i)"""
)
def quantile_sample(spark, sf):
    return identity.quantile_sample(fixtures(spark, sf).select("match_date").distinct(), "match_date", 3, 10)


@query("SELECT c_custkey, regexp_replace(lower(c_name || ' & ' || c_mktsegment),'[^a-z0-9]+','_','g') AS slug FROM customer")
def safe_slugs(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", sinks.safe_slug(F.concat("c_name", F.lit(" & "), "c_mktsegment")).alias("slug"))
