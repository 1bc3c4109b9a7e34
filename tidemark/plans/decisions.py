"""Gates, folds, rules, controls, resampling and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import market
from ..operators import evaluation as ev
from ..operators import selection as sel
from .analysis import EDGE, RULES, Y, _scored, _temperature_grid
from .base import FX, fixtures, query, r6
from .scalars import NOVIG, SETTLE, odds, settled

BLEND = "0.5*ph+0.225 AS mh, 0.5*pd+0.135 AS md, 0.5*pa+0.14 AS ma"


def _metrics_sql(source: str, a: str, b: str, c: str) -> str:
    return f"SELECT league, '{source}' AS source, y, {a} AS a, {b} AS b, {c} AS c FROM y"


@query(
    f"""WITH {NOVIG}, y AS (SELECT *, {Y} AS y, {BLEND} FROM p), u AS ({_metrics_sql('model', 'mh', 'md', 'ma')} UNION ALL {_metrics_sql('market', 'ph', 'pd', 'pa')}),
t AS (SELECT *, greatest(a,b,c) AS conf, (CASE WHEN a>=b AND a>=c THEN 0 WHEN b>=c THEN 1 ELSE 2 END = y)::INT AS hit FROM u),
m AS (SELECT league, source, avg(-ln(CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END)) AS ll, avg(pow(a-(y=0)::INT,2)+pow(b-(y=1)::INT,2)+pow(c-(y=2)::INT,2)) AS br, avg(hit) AS acc FROM t GROUP BY 1,2),
g AS (SELECT league, source, least(floor(conf*10),9) AS k, count(*) AS n, avg(conf) AS c, avg(hit) AS h FROM t GROUP BY 1,2,3), e AS (SELECT league, source, sum(n*abs(c-h))/sum(n) AS ece FROM g GROUP BY 1,2),
d AS (SELECT x.league, x.ll-z.ll AS dl, x.br-z.br AS db, ex.ece-ez.ece AS de, x.acc-z.acc AS da FROM m x JOIN m z ON x.league=z.league AND x.source='model' AND z.source='market' JOIN e ex ON ex.league=x.league AND ex.source='model' JOIN e ez ON ez.league=x.league AND ez.source='market')
SELECT league, round(dl,6) AS delta_log_loss, round(db,6) AS delta_brier, round(de,6) AS delta_ece, round(da,6) AS delta_accuracy, dl<0 AND db<=0.0005 AND de<=0.01 AS passed FROM d"""
)
def predictive_gate(spark, sf):
    s = _scored(spark, sf)
    sides = {"model": [0.5 * F.col("ph") + 0.225, 0.5 * F.col("pd") + 0.135, 0.5 * F.col("pa") + 0.14], "market": [F.col("ph"), F.col("pd"), F.col("pa")]}
    rows = sel.side_rows(s, ["league", "y"], {k: dict(zip("abc", ps)) for k, ps in sides.items()})
    ps, y = [F.col("a"), F.col("b"), F.col("c")], F.col("y")
    hit = F.when((F.col("a") >= F.col("b")) & (F.col("a") >= F.col("c")), 0).when(F.col("b") >= F.col("c"), 1).otherwise(2) == y
    plain = rows.groupBy("league", "side").agg(ev.multiclass_log_loss(ps, y).alias("log_loss"), ev.multiclass_brier(ps, y).alias("brier"), F.avg(hit.cast("double")).alias("accuracy"))
    ece = ev.calibration_error(rows, ["league", "side"], F.greatest(*ps), hit, ev.bin_left(F.greatest(*ps), 10))
    both = plain.join(ece, ["league", "side"])
    names = ("log_loss", "brier", "ece", "accuracy")
    wide = both.groupBy("league").agg(*[F.max(F.when(F.col("side") == k, F.col(m))).alias(f"{k}_{m}") for k in sides for m in names])
    return sel.predictive_gate(wide).select("league", *[r6(f"delta_{m}").alias(f"delta_{m}") for m in names], "passed")


@query(
    f"""WITH {NOVIG}, y AS (SELECT *, {Y} AS y FROM p), g AS (SELECT a*0.25 AS alpha, 0.8+t*0.2 AS temp FROM (SELECT range AS a FROM range(5)), (SELECT range AS t FROM range(3))),
l AS (SELECT alpha, temp, y, exp(((1-alpha)*ln(ph)+alpha*ln(0.45))/temp) AS a, exp(((1-alpha)*ln(pd)+alpha*ln(0.27))/temp) AS b, exp(((1-alpha)*ln(pa)+alpha*ln(0.28))/temp) AS c FROM y, g),
q AS (SELECT alpha, temp, y, a/(a+b+c) AS a, b/(a+b+c) AS b, c/(a+b+c) AS c FROM l), s AS (SELECT alpha, temp, round(avg(-ln(CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END)),6) AS logloss, round(avg(pow(a-(y=0)::INT,2)+pow(b-(y=1)::INT,2)+pow(c-(y=2)::INT,2)),6) AS brier FROM q GROUP BY 1,2)
SELECT round(alpha,2)::DOUBLE AS alpha, round(temp,2)::DOUBLE AS temperature, logloss, brier FROM s ORDER BY logloss, brier, alpha, abs(temp-1) LIMIT 1"""
)
def calibration_best(spark, sf):
    scores = _temperature_grid(spark, sf, 5, 3).withColumns({c: r6(c) for c in ("logloss", "brier")})
    return sel.best_setting(scores)


YEARS = "y AS (SELECT season, count(*) AS n, row_number() OVER (ORDER BY season) - 1 AS i FROM fx GROUP BY 1)"


def _years(spark, sf):
    counts = fixtures(spark, sf).groupBy("season").agg(F.count(F.lit(1)).alias("n"))
    return counts, [r.season for r in counts.select("season").orderBy("season").collect()]  # one row per year


@query(
    f"""WITH {FX}, {YEARS}, f AS (SELECT i AS t, i-2 AS fold FROM y WHERE i>=3) SELECT fold::INT AS fold, CASE WHEN y.i=t THEN 'test' WHEN y.i=t-1 THEN 'calibration' WHEN y.i=t-2 THEN 'tune' ELSE 'train' END AS role, sum(n)::BIGINT AS rows FROM f JOIN y ON y.i<=t GROUP BY 1,2"""
)
def positional_folds(spark, sf):
    counts, years = _years(spark, sf)
    return sel.fold_sizes(counts, "season", "n", sel.positional_folds(years))


@query(
    f"""WITH {FX}, {YEARS}, f AS (SELECT t.season AS test, b.season AS s, b.n, row_number() OVER (PARTITION BY t.season ORDER BY b.season DESC) AS back, count(*) OVER (PARTITION BY t.season) AS m FROM y t JOIN y b ON b.season<t.season-1)
SELECT test::INT AS fold, CASE WHEN back=1 AND m>1 THEN 'calibration' ELSE 'train' END AS role, sum(n)::BIGINT AS rows FROM f GROUP BY 1,2 UNION ALL SELECT season::INT, 'test', n FROM y WHERE season IN (SELECT test FROM f)"""
)
def expanding_seasons_purged(spark, sf):
    counts, years = _years(spark, sf)
    folds = [{"fold": y, **sel.expanding_partition(years, y, 1)} for y in years if any(b < y - 1 for b in years)]
    return sel.fold_sizes(counts, "season", "n", folds)


GRID = f"{SETTLE}, {RULES}, j AS (SELECT rule_id, season, league, profit FROM s JOIN rules ON {EDGE} >= min_edge AND odds_h >= min_odds)"


@query(
    f"""WITH {GRID}, o AS (SELECT rule_id, sum(profit) AS control FROM s JOIN rules ON {EDGE} < min_edge AND odds_h >= min_odds GROUP BY 1),
t AS (SELECT rule_id, count(*) AS bets, sum(profit) AS profit, avg(profit) AS roi, coalesce(sum(profit)/nullif(stddev_samp(profit)*sqrt(count(*)),0),0) AS z FROM j GROUP BY 1),
yr AS (SELECT rule_id, count(*) AS years, max(p) AS best_year FROM (SELECT rule_id, season, sum(profit) AS p FROM j GROUP BY 1,2) GROUP BY 1), lg AS (SELECT rule_id, max(p) AS best_league FROM (SELECT rule_id, league, sum(profit) AS p FROM j GROUP BY 1,2) GROUP BY 1)
SELECT t.rule_id, bets, round(profit,6) AS profit, CASE WHEN profit<=0 OR roi<=0.02 OR z<1 OR years<4 THEN 'predictive_only_no_value' WHEN best_year>0.5*profit OR best_league>0.5*profit OR profit-best_year<=0 OR coalesce(control,-1e9)>=profit THEN 'research_only' ELSE 'forward_paper_candidate' END AS decision
FROM t JOIN yr USING (rule_id) JOIN lg USING (rule_id) LEFT JOIN o USING (rule_id)"""
)
def decision_ladder(spark, sf):
    # rules and bets meet once; the sums by year and by league are sums over that one small table
    rules = spark.range(15).select((F.floor(F.col("id") / 3) * 10 + F.col("id") % 3).alias("rule_id"), (F.floor(F.col("id") / 3) * 0.02).alias("min_edge"), (F.col("id") % 3 + 1.5).alias("min_odds"))
    bets = settled(fixtures(spark, sf)).select("season", "league", "profit", "odds_h", F.expr(EDGE).alias("edge"))
    taken = F.col("edge") >= F.col("min_edge")
    cells = bets.join(F.broadcast(rules), F.col("odds_h") >= F.col("min_odds")).groupBy("rule_id", "season", "league").agg(  # 15 rules
        F.count_if(taken).alias("n"), F.sum(F.when(taken, F.col("profit"))).alias("p"), F.sum(F.when(taken, F.col("profit") * F.col("profit"))).alias("q"), F.sum(F.when(~taken, F.col("profit"))).alias("control")
    )
    by = lambda c: cells.groupBy("rule_id", c).agg(F.sum("p").alias("p")).where("p IS NOT NULL").groupBy("rule_id").agg(F.count(F.lit(1)).alias(f"n_{c}"), F.max("p").alias(f"best_{c}"))
    t = cells.groupBy("rule_id").agg(F.sum("n").alias("bets"), F.sum("p").alias("profit"), F.sum("q").alias("q"), F.sum("control").alias("control")).where("bets > 0")
    n, p = F.col("bets"), F.col("profit")
    sd = F.sqrt(F.greatest((F.col("q") - p * p / n) / (n - 1), F.lit(0.0)))
    z = F.coalesce(F.try_divide(p, sd * F.sqrt(n)), F.lit(0.0))
    t = t.join(by("season"), "rule_id").join(by("league"), "rule_id")
    status = sel.decision(n, p, p / n, z, F.col("n_season"), F.col("best_season"), F.col("best_league"), p - F.col("best_season"), F.col("control"))
    return t.select("rule_id", "bets", r6("profit").alias("profit"), status.alias("decision"))


@query(
    f"""WITH {GRID}, y AS (SELECT rule_id, season, count(*) AS n, sum(profit) AS p FROM j GROUP BY 1,2), f AS (SELECT DISTINCT season AS test FROM fx WHERE season>(SELECT min(season) FROM fx)),
c AS (SELECT f.test, y.rule_id, sum(n) AS bets, sum(p) AS profit, sum(p)/sum(n) AS roi FROM f JOIN y ON y.season<f.test GROUP BY 1,2), b AS (SELECT *, row_number() OVER (PARTITION BY test ORDER BY round(roi,9) DESC, bets DESC, rule_id) AS rn FROM c WHERE bets>=50)
SELECT b.test AS season, b.rule_id, coalesce(y.n,0)::BIGINT AS test_bets, round(coalesce(y.p,0),6) AS test_profit FROM b LEFT JOIN y ON y.rule_id=b.rule_id AND y.season=b.test WHERE rn=1"""
)
def nested_value_scan(spark, sf):
    # one row per rule and year; what a fold may know of a rule is a running sum over its earlier years
    rules = spark.range(15).select((F.floor(F.col("id") / 3) * 10 + F.col("id") % 3).alias("rule_id"), (F.floor(F.col("id") / 3) * 0.02).alias("min_edge"), (F.col("id") % 3 + 1.5).alias("min_odds"))
    fx = settled(fixtures(spark, sf)).withColumn("edge", F.expr(EDGE))
    years = fx.select("season").distinct()
    cells = fx.join(F.broadcast(rules), (F.col("edge") >= F.col("min_edge")) & (F.col("odds_h") >= F.col("min_odds"))).groupBy("rule_id", "season").agg(F.count(F.lit(1)).alias("n"), F.sum("profit").alias("p"))  # 15 rules
    full = rules.select("rule_id").crossJoin(F.broadcast(years)).join(cells, ["rule_id", "season"], "left")  # one row per rule and year
    before = Window.partitionBy("rule_id").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("bets", F.sum("n").over(before)).withColumn("roi", F.sum("p").over(before) / F.sum("n").over(before))
    best = Window.partitionBy("season").orderBy(F.round("roi", 9).desc(), F.col("bets").desc(), "rule_id")
    picked = full.where("bets >= 50").withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return picked.select("season", "rule_id", F.coalesce("n", F.lit(0)).alias("test_bets"), r6(F.coalesce("p", F.lit(0.0))).alias("test_profit"))


@query(
    f"""WITH {SETTLE}, c AS (SELECT season+1 AS season, unnest([0.5,0.6,0.7,0.8]) AS q FROM (SELECT DISTINCT season FROM fx)), t AS (SELECT c.season, c.q, quantile_cont(s.odds_a, 0.5) AS q5, quantile_cont(s.odds_a, 0.6) AS q6, quantile_cont(s.odds_a, 0.7) AS q7, quantile_cont(s.odds_a, 0.8) AS q8 FROM c JOIN s ON s.season=c.season-1 GROUP BY 1,2),
u AS (SELECT season, q, CASE q WHEN 0.5 THEN q5 WHEN 0.6 THEN q6 WHEN 0.7 THEN q7 ELSE q8 END AS cut FROM t), m AS (SELECT u.season, u.q, u.cut, count(*) AS bets, sum(profit) AS profit, avg(profit) AS roi, coalesce(sum(profit)/nullif(stddev_samp(profit)*sqrt(count(*)),0),0) AS z FROM u JOIN s ON s.season=u.season-1 AND s.odds_a>=u.cut GROUP BY 1,2,3),
r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY round(z,9) DESC, round(roi,9) DESC, bets DESC, q) AS rn FROM m WHERE bets>=8 AND profit>0 AND roi>0)
SELECT season, q::DOUBLE AS quantile, round(cut,6) AS cut, bets, round(roi,6) AS roi FROM r WHERE rn=1"""
)
def threshold_search(spark, sf):
    fx = settled(fixtures(spark, sf)).select((F.col("season") + 1).alias("season"), "odds_a", "profit")
    qs = [0.5, 0.6, 0.7, 0.8]
    cuts = fx.groupBy("season").agg(F.percentile("odds_a", F.array(*map(F.lit, qs))).alias("c"))
    cuts = cuts.select("season", F.inline(F.arrays_zip(F.array(*map(F.lit, qs)).alias("quantile"), F.col("c").alias("cut"))))
    m = ev.bet_summary(fx.join(cuts, "season").where("odds_a >= cut"), ["season", "quantile", "cut"])
    w = Window.partitionBy("season").orderBy(F.round("z", 9).desc(), F.round("roi", 9).desc(), F.desc("bets"), "quantile")
    best = m.where("bets >= 8 AND profit > 0 AND roi > 0").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return best.select("season", "quantile", r6("cut").alias("cut"), "bets", r6("roi").alias("roi"))


MONTHS = f"{FX}, g AS (SELECT date_trunc('month', match_date)::DATE AS block, sum(abs(hg-ag-(odds_a-odds_h))) AS m, sum(abs(hg-ag)) AS z, count(*) AS n FROM fx GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY block) - 1 AS i, count(*) OVER () AS k FROM g)"


def _draws(iterations: int, salt: str) -> str:
    return f"slots AS (SELECT b, j, ('0x' || substr(sha256('{salt}-' || b || '-' || j),1,12))::BIGINT % k AS i FROM (SELECT range AS b FROM range({iterations})), (SELECT DISTINCT k FROM i), unnest(range(k)) AS t(j))"


@query(f"WITH {MONTHS}, {_draws(100, 'mae')} SELECT b::BIGINT AS replicate, round(sum(m)/sum(n)-sum(z)/sum(n),6) AS model_minus_zero_mae FROM slots JOIN i USING (i) GROUP BY 1")
def month_bootstrap_mae(spark, sf):
    fx = fixtures(spark, sf).withColumn("block", F.trunc("match_date", "month"))
    margin, model = F.col("hg") - F.col("ag"), F.col("odds_a") - F.col("odds_h")
    draws = sel.block_bootstrap(fx, "block", {"m": F.sum(F.abs(margin - model)), "z": F.sum(F.abs(margin)), "n": F.count(F.lit(1))}, 100, "mae")
    return draws.select("replicate", r6((F.col("m") - F.col("z")) / F.col("n")).alias("model_minus_zero_mae"))


WEEKS = f"{SETTLE}, g AS (SELECT date_trunc('week', match_date)::DATE AS block, sum(profit) AS p, count(*) AS n FROM s GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY block) - 1 AS i, count(*) OVER () AS k FROM g)"


@query(
    f"""WITH {WEEKS}, {_draws(200, '17')}, r AS (SELECT b, sum(p) AS p, sum(n) AS n FROM slots JOIN i USING (i) GROUP BY 1)
SELECT round(quantile_cont(p,0.025),6) AS profit_low, round(quantile_cont(p,0.975),6) AS profit_high, round(avg(CASE WHEN p>0 THEN 1.0 ELSE 0 END),6) AS p_positive, round(avg(p/n),6) AS roi_mean FROM r"""
)
def cluster_bootstrap(spark, sf):
    bets = settled(fixtures(spark, sf)).withColumn("week", F.date_trunc("week", "match_date"))
    r = sel.block_bootstrap(bets, "week", {"p": F.sum("profit"), "n": F.count(F.lit(1))}, 200)
    q = lambda x: r6(F.percentile("p", F.lit(x)))
    return r.agg(q(0.025).alias("profit_low"), q(0.975).alias("profit_high"), r6(F.avg((F.col("p") > 0).cast("double"))).alias("p_positive"), r6(F.avg(F.col("p") / F.col("n"))).alias("roi_mean"))


POOL = f"""{SETTLE}, pool AS (SELECT match_id, league, season, odds_h, odds_a, {EDGE} AS edge, profit AS hp,
((CASE WHEN ag-hg-l1>0 THEN odds_a-1 WHEN ag-hg-l1<0 THEN -1.0 ELSE 0 END)+(CASE WHEN ag-hg-l2>0 THEN odds_a-1 WHEN ag-hg-l2<0 THEN -1.0 ELSE 0 END))/2 AS ap FROM s), chosen AS (SELECT * FROM pool WHERE edge>=0.05)"""


def _same_sql(strata: str, salt: str) -> str:
    return f"SELECT r.hp AS p FROM (SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY sha256('{salt}' || match_id), match_id) AS rn FROM pool) r JOIN (SELECT {strata}, count(*) AS n FROM chosen GROUP BY ALL) c USING ({strata}) WHERE rn<=n"


def _shuffle_sql(keys: str, salt: str) -> str:
    base = "SELECT *, ('0x' || substr(sha256(CAST(match_id AS VARCHAR)),1,5))::BIGINT % 1024 AS share FROM pool"
    return f"SELECT a.hp AS p FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY match_id) AS rn FROM ({base})) a JOIN (SELECT {keys}, edge AS e, row_number() OVER (PARTITION BY {keys} ORDER BY sha256('{salt}' || match_id), match_id) AS rn FROM ({base})) b USING ({keys}, rn) WHERE e>=0.05"


@query(
    f"""WITH {POOL}, u AS (SELECT 'selected' AS control, hp AS p FROM chosen UNION ALL SELECT 'random_same_size', p FROM ({_same_sql('season', '11')}) UNION ALL SELECT 'random_same_league', p FROM ({_same_sql('league, season', '12')})
UNION ALL SELECT 'opposite_side', ap FROM chosen UNION ALL SELECT 'always_home', hp FROM pool UNION ALL SELECT 'always_away', ap FROM pool UNION ALL SELECT 'shuffled_edge', p FROM ({_shuffle_sql('share', '13')}) UNION ALL SELECT 'permuted_within_league_season', p FROM ({_shuffle_sql('league, season', '14')})
UNION ALL SELECT 'market_top', hp FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY odds_h, match_id) AS rn FROM pool) r JOIN (SELECT season, count(*) AS n FROM chosen GROUP BY 1) c USING (season) WHERE rn<=n)
SELECT control, count(*) AS bets, round(sum(p),6) AS profit FROM u GROUP BY 1"""
)
def control_battery(spark, sf):
    fx = settled(fixtures(spark, sf))
    away = market.handicap_profit(F.col("ag") - F.col("hg"), -F.col("ah_line"), F.col("odds_a"))
    pool = fx.select("match_id", "league", "season", "odds_h", F.expr(EDGE).alias("edge"), F.col("profit").alias("hp"), away.alias("ap"))
    chosen = pool.where("edge >= 0.05")
    sizes = lambda *keys: chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    top = Window.partitionBy("season").orderBy("odds_h", "match_id")
    parts = {
        "selected": (chosen, "hp"),
        "random_same_size": (sel.same_size(pool, sizes("season"), ["season"], "match_id", "11"), "hp"),
        "random_same_league": (sel.same_size(pool, sizes("league", "season"), ["league", "season"], "match_id", "12"), "hp"),
        "opposite_side": (chosen, "ap"),
        "always_home": (pool, "hp"),
        "always_away": (pool, "ap"),
        "shuffled_edge": (sel.shuffled(pool, "edge", "match_id", [], "13").where("edge >= 0.05"), "hp"),
        "permuted_within_league_season": (sel.shuffled(pool, "edge", "match_id", ["league", "season"], "14").where("edge >= 0.05"), "hp"),
        "market_top": (pool.withColumn("rn", F.row_number().over(top)).join(sizes("season"), "season").where("rn <= n"), "hp"),
    }
    rows = None
    for name, (df, p) in parts.items():
        own = df.agg(F.lit(name).alias("control"), F.count(F.lit(1)).alias("bets"), r6(F.sum(p)).alias("profit"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


#: What the rules can ask of a side, in SQL that Spark and DuckDB read alike, and the rules.
CONDITIONS = {
    "priced": "odds BETWEEN 1.5 AND 5 AND model IS NOT NULL",
    "worth_it": "edge >= 0.01 AND model * odds - 1 > 0",
    "will_shorten": "clv >= 0 AND pclv >= 0.4",
    "certain": "unc <= 0.6",
    "agreed": "agrees",
    "disputed": "disp >= 0.5",
}
RULES = {
    "outcome_edge_only": ("priced", "worth_it"),
    "predicted_clv_only": ("priced", "will_shorten"),
    "edge_and_uncertainty": ("priced", "worth_it", "will_shorten", "certain"),
    "cross_market": ("priced", "worth_it", "will_shorten", "agreed"),
    "bookmaker_disagreement": ("priced", "worth_it", "will_shorten", "disputed"),
}


def _variant_sql(name: str) -> str:
    return f"SELECT '{name}' AS variant, match_id, side, odds, won, row_number() OVER (PARTITION BY match_id ORDER BY round(edge,12) DESC, side) AS rn FROM f WHERE {' AND '.join(CONDITIONS[c] for c in RULES[name])}"


SIGNALS = {"model_shift": "(CAST((match_id*29) % 97 AS DOUBLE)/97*0.2-0.1)", "clv": "(CAST((match_id*11) % 21 AS DOUBLE)-10)/100", "pclv": "CAST((match_id*17) % 10 AS DOUBLE)/10", "unc": "CAST((match_id*19) % 11 AS DOUBLE)/10", "disp": "CAST((match_id*23) % 10 AS DOUBLE)/10"}


@query(
    f"""WITH {NOVIG}, f0 AS (SELECT match_id, 'home' AS side, odds_h AS odds, ph+{SIGNALS['model_shift']} AS model, hg>ag AS won, match_id%3=0 AS agrees FROM p UNION ALL SELECT match_id, 'draw', odds_d, pd, hg=ag, FALSE FROM p UNION ALL SELECT match_id, 'away', odds_a, pa-{SIGNALS['model_shift']}, ag>hg, match_id%3=1 FROM p),
f AS (SELECT *, model-1/odds AS edge, {SIGNALS['clv']} AS clv, {SIGNALS['pclv']} AS pclv, {SIGNALS['unc']} AS unc, {SIGNALS['disp']} AS disp FROM f0), u AS ({' UNION ALL '.join(_variant_sql(v) for v in RULES)})
SELECT variant, side, count(*) AS bets, round(sum(CASE WHEN won THEN odds-1 ELSE -1 END),6) AS profit FROM u WHERE rn=1 GROUP BY 1,2"""
)
def rule_variants(spark, sf):
    p, e = market.novig(odds()), F.expr
    shift = e(SIGNALS["model_shift"])
    fx = fixtures(spark, sf)
    rows = sel.side_rows(fx, ["match_id"], {
        "home": {"odds": F.col("odds_h"), "model": p[0] + shift, "won": F.col("hg") > F.col("ag"), "agrees": F.col("match_id") % 3 == 0},
        "draw": {"odds": F.col("odds_d"), "model": p[1], "won": F.col("hg") == F.col("ag"), "agrees": F.lit(False)},
        "away": {"odds": F.col("odds_a"), "model": p[2] - shift, "won": F.col("ag") > F.col("hg"), "agrees": F.col("match_id") % 3 == 1},
    }).withColumn("edge", F.col("model") - 1 / F.col("odds"))
    rows = rows.withColumns({c: e(SIGNALS[c]) for c in ("clv", "pclv", "unc", "disp")})
    # all rules in one pass: a row stands once for each rule that takes it
    taken = rows.withColumn("variant", F.explode(sel.rules_met(RULES, {n: e(c) for n, c in CONDITIONS.items()})))
    w = Window.partitionBy("variant", "match_id").orderBy(F.round("edge", 12).desc(), "side")
    best = taken.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return best.groupBy("variant", "side").agg(F.count(F.lit(1)).alias("bets"), r6(F.sum(market.settle_1x2(F.col("won"), F.col("odds")))).alias("profit"))


@query(f"WITH {FX} SELECT match_id, ah_line, round(odds_a,6) AS away_odds FROM fx WHERE odds_a>1 AND (ah_line<=-1.25 OR -ah_line>=1.25)")
def line_candidates(spark, sf):
    fx = fixtures(spark, sf).withColumn("away_line", -F.col("ah_line"))
    return sel.line_candidates(fx, "ah_line", "away_line", "odds_a", -1.25).select("match_id", "ah_line", r6("odds_a").alias("away_odds"))


@query(
    f"""WITH {FX}, c AS (SELECT league, season, match_id%4=0 AS covered, league IN ('4-NOT SPECIFIED','5-LOW') AS lower FROM fx) SELECT 'full' AS scope, count(*) AS n FROM c UNION ALL SELECT 'covered', count(*) FROM c WHERE covered UNION ALL SELECT 'top', count(*) FROM c WHERE NOT lower UNION ALL SELECT 'modern_covered', count(*) FROM c WHERE covered AND season>=1996"""
)
def scope_counts(spark, sf):
    fx = fixtures(spark, sf).withColumn("covered", F.col("match_id") % 4 == 0)
    out = None
    for name in ("full", "covered", "top", "modern_covered"):
        own = sel.scope(fx, name, "league", "season", "covered", ["4-NOT SPECIFIED", "5-LOW"], 1996).agg(F.lit(name).alias("scope"), F.count(F.lit(1)).alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"WITH {FX}, t AS (SELECT CASE match_id%5 WHEN 0 THEN 'True' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN 'YES' END AS v, CASE WHEN match_id%2=0 THEN 'home' ELSE 'away' END AS side FROM fx) SELECT coalesce(lower(v) IN ('true','1','yes'), FALSE) AS flag, CASE side WHEN 'home' THEN 'away' ELSE 'home' END AS other, count(*) AS n FROM t GROUP BY 1,2")
def truthy_flags(spark, sf):
    m = F.col("match_id") % 5
    v = F.when(m == 0, "True").when(m == 1, "no").when(m == 2, "1").when(m == 3, "YES")
    side = F.when(F.col("match_id") % 2 == 0, "home").otherwise("away")
    return fixtures(spark, sf).groupBy(sel.truthy(v).alias("flag"), sel.opposite(side).alias("other")).agg(F.count(F.lit(1)).alias("n"))
