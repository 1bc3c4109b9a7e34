"""Models that start from the market: boosting with a base margin, nested selection, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import market
from ..operators import boosting, calibration, nested, selection
from .base import FX, fixtures, query, r6

#: Bin edges of the features, and the model's size.
EDGES = {"odds_d": [3.0, 3.5, 4.0, 4.5, 5.0], "ah_line": [-1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5], "gap": [-2.0, -1.0, 0.0, 1.0, 2.0]}
ROUNDS, ETA, REG, LEAST = 3, 0.3, 1.0, 5.0

_GAIN = "power(gl,2)/(hl+1.0)+power(tg-gl,2)/(th-hl+1.0)-power(tg,2)/(th+1.0)"


def _boost_sql() -> str:
    """The boosting written out: per round a level of one node, a level of two, and the leaves."""
    bins = ", ".join("CASE WHEN {0} IS NULL THEN -1 ELSE {1} END".format(c, "+".join(f"({c}>{e})::INT" for e in es)) for c, es in EDGES.items())
    out = [f"{FX}, x AS (SELECT match_id, season, (hg>ag)::INT::DOUBLE AS y, (1/odds_h)/(1/odds_h+1/odds_d+1/odds_a) AS mp, odds_d, ah_line, CASE WHEN match_id%9<>0 THEN odds_h-odds_a END AS gap FROM fx)", f"m0 AS (SELECT match_id, season, y, mp, ln(mp/(1-mp)) AS m, [{bins}] AS b FROM x)"]
    for r in range(1, ROUNDS + 1):
        out.append(f"g{r} AS (SELECT *, 1/(1+exp(-m))-y AS g, (1/(1+exp(-m)))*(1-1/(1+exp(-m))) AS h FROM m{r - 1})")
        rows, keys = f"(SELECT 1 AS node, * FROM g{r})", {}
        for level in ("a", "b"):
            out.append(f"h{r}{level} AS (SELECT node, f, b[f] AS k, sum(g) AS g, sum(h) AS h FROM {rows}, unnest([1,2,3]) AS u(f) WHERE season<1998 GROUP BY ALL)")
            out.append(f"c{r}{level} AS (SELECT node, f, k, ml, sum(CASE WHEN k>=0 THEN g ELSE 0 END) OVER w + CASE WHEN ml THEN coalesce(mg,0) ELSE 0 END AS gl, sum(CASE WHEN k>=0 THEN h ELSE 0 END) OVER w + CASE WHEN ml THEN coalesce(mh,0) ELSE 0 END AS hl, tg, th FROM (SELECT *, sum(CASE WHEN k<0 THEN g END) OVER q AS mg, sum(CASE WHEN k<0 THEN h END) OVER q AS mh, sum(g) OVER q AS tg, sum(h) OVER q AS th FROM h{r}{level} WINDOW q AS (PARTITION BY node, f)), unnest([TRUE, FALSE]) AS v(ml) WINDOW w AS (PARTITION BY node, f, ml ORDER BY k))")
            out.append(f"s{r}{level} AS (SELECT *, -{ETA}*gl/(hl+{REG}) AS lv, -{ETA}*(tg-gl)/(th-hl+{REG}) AS rv FROM c{r}{level} WHERE k>=0 AND hl>={LEAST} AND th-hl>={LEAST} QUALIFY row_number() OVER (PARTITION BY node ORDER BY round({_GAIN},8) DESC, f, CASE WHEN ml THEN 0 ELSE 1 END, k)=1)")
            rows = f"(SELECT 2*s.node+CASE WHEN CASE WHEN b[s.f]<0 THEN s.ml ELSE b[s.f]<=s.k END THEN 0 ELSE 1 END AS node, g{r}.* FROM g{r} CROSS JOIN s{r}a s)"
            keys[level] = rows
        out.append(f"m{r} AS (SELECT match_id, season, y, mp, m+CASE WHEN CASE WHEN b[s.f]<0 THEN s.ml ELSE b[s.f]<=s.k END THEN s.lv ELSE s.rv END AS m, b FROM {keys['a']} n JOIN s{r}b s USING (node))")
    return "WITH " + ",\n".join(out)


def _boosted(spark, sf):
    fx = fixtures(spark, sf).withColumn("y", (F.col("hg") > F.col("ag")).cast("double")).withColumn("mp", market.novig([F.col("odds_h"), F.col("odds_d"), F.col("odds_a")])[0])
    fx = fx.withColumn("gap", F.when(F.col("match_id") % 9 != 0, F.col("odds_h") - F.col("odds_a"))).withColumn("base", F.ln(F.col("mp") / (1 - F.col("mp"))))
    model = boosting.boost(fx.where("season < 1998"), list(EDGES), "y", F.col("base"), list(EDGES.values()), rounds=ROUNDS, eta=ETA, reg=REG, least=LEAST)
    return fx.where("season = 1998").withColumn("p", model.probability(F.col("base")))


@query(f"{_boost_sql()} SELECT match_id, round(mp,6) AS p_market, round(1/(1+exp(-m)),6) AS p_model FROM m{ROUNDS} WHERE season=1998")
def boosting_base_margin(spark, sf):
    return _boosted(spark, sf).select("match_id", r6("mp").alias("p_market"), r6("p").alias("p_model"))


@query(f"{_boost_sql()}, t AS (SELECT y, mp, 1/(1+exp(-m)) AS p FROM m{ROUNDS} WHERE season=1998) SELECT count(*) AS n, round(avg(-ln(CASE WHEN y=1 THEN mp ELSE 1-mp END)),6) AS market_log_loss, round(avg(-ln(CASE WHEN y=1 THEN p ELSE 1-p END)),6) AS model_log_loss FROM t")
def boosting_holdout(spark, sf):
    own = lambda p: r6(F.avg(-F.ln(F.when(F.col("y") == 1, F.col(p)).otherwise(1 - F.col(p)))))
    return _boosted(spark, sf).agg(F.count(F.lit(1)).alias("n"), own("mp").alias("market_log_loss"), own("p").alias("model_log_loss"))


# nested selection

SETS = {"gap": ["gap"], "gap_line": ["gap", "ah_line"], "line": ["ah_line"]}
REGS, ALPHAS = [10.0, 1000.0], [0.25, 0.5, 1.0]

_WEIGHTS = {"gap": "b1/(a11+reg), 0.0", "line": "0.0, b2/(a22+reg)", "gap_line": "((a22+reg)*b1-a12*b2)/((a11+reg)*(a22+reg)-a12*a12), ((a11+reg)*b2-a12*b1)/((a11+reg)*(a22+reg)-a12*a12)"}


@query(
    f"""WITH {FX}, x AS (SELECT season AS year, odds_h-odds_a AS u, ah_line AS v, (hg>ag)::INT-(1/odds_h)/(1/odds_h+1/odds_d+1/odds_a) AS r FROM fx),
s AS (SELECT year, count(*) AS n, sum(u*u) AS s11, sum(u*v) AS s12, sum(v*v) AS s22, sum(u*r) AS t1, sum(v*r) AS t2 FROM x GROUP BY 1),
c AS (SELECT *, row_number() OVER (ORDER BY year) AS k, sum(s11) OVER w AS a11, sum(s12) OVER w AS a12, sum(s22) OVER w AS a22, sum(t1) OVER w AS b1, sum(t2) OVER w AS b2 FROM s WINDOW w AS (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS ({' UNION ALL '.join(f"SELECT *, '{n}' AS feature_set, {w.split(', ')[0]} AS w1, {w.split(', ')[1]} AS w2 FROM c, (VALUES (10.0), (1000.0)) AS q(reg) WHERE k>2" for n, w in _WEIGHTS.items())}),
d AS (SELECT year, n, feature_set, reg, alpha, (alpha*alpha*(w1*w1*s11+2*w1*w2*s12+w2*w2*s22)-2*alpha*(w1*t1+w2*t2))/n AS delta FROM f, (VALUES (0.25), (0.5), (1.0)) AS z(alpha)),
e AS (SELECT *, count(*) OVER w AS validations, avg(delta) OVER w AS vd FROM d WINDOW w AS (PARTITION BY feature_set, reg, alpha ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT year AS test_year, feature_set, reg::DOUBLE AS reg, alpha::DOUBLE AS alpha, validations, round(vd,9) AS validation_delta, n, round(delta,9) AS test_delta FROM e WHERE validations>0 QUALIFY row_number() OVER (PARTITION BY year ORDER BY round(vd,12), alpha, reg DESC, feature_set)=1"""
)
def nested_feature_selection(spark, sf):
    p = market.novig([F.col("odds_h"), F.col("odds_d"), F.col("odds_a")])[0]
    fx = fixtures(spark, sf).withColumn("gap", F.col("odds_h") - F.col("odds_a"))
    out = nested.nested_selection(fx, "season", ["gap", "ah_line"], (F.col("hg") > F.col("ag")).cast("double") - p, SETS, REGS, ALPHAS, 2)
    return out.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in ("validation_delta", "test_delta")})


_NOISE = lambda k: f"((('0x' || substr(sha256('17-gap-{k}-' || match_id),1,12))::BIGINT+0.5)/281474976710656.0)"


@query(
    f"""WITH {FX}, s AS (SELECT avg(odds_h-odds_a) AS m, stddev_samp(odds_h-odds_a) AS d FROM fx WHERE season<1997), x AS (SELECT season, odds_h-odds_a AS gap, m+d*sqrt(-2*ln({_NOISE(1)}))*cos(2*pi()*{_NOISE(2)}) AS noise, (hg>ag)::INT-(1/odds_h)/(1/odds_h+1/odds_d+1/odds_a) AS r FROM fx, s),
u AS (SELECT 'feature' AS control, season, gap AS v, r FROM x UNION ALL SELECT 'noise', season, noise, r FROM x), g AS (SELECT control, season, count(*) AS n, sum(v*v) AS a, sum(v*r) AS b FROM u GROUP BY 1,2), w AS (SELECT *, sum(b) OVER q/(sum(a) OVER q+1000.0) AS w, row_number() OVER (PARTITION BY control ORDER BY season) AS k FROM g WINDOW q AS (PARTITION BY control ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT control, season AS year, round((w*w*a-2*w*b)/n,9) AS delta FROM w WHERE k>2"""
)
def noise_control(spark, sf):
    p = market.novig([F.col("odds_h"), F.col("odds_d"), F.col("odds_a")])[0]
    fx = fixtures(spark, sf).withColumn("gap", F.col("odds_h") - F.col("odds_a")).withColumn("r", (F.col("hg") > F.col("ag")).cast("double") - p)
    parts = {"feature": fx, "noise": selection.noise_replaced(fx, ["gap"], F.col("season") < 1997, "match_id", "17")}
    rows = None
    for name, df in parts.items():
        scores = nested.candidate_scores(nested.year_sums(df, "season", ["gap"], F.col("r")), ["gap"], {"gap": ["gap"]}, [1000.0], [1.0], 2)
        own = scores.select(F.lit(name).alias("control"), "year", (F.round("delta", 9) + F.lit(0.0)).alias("delta"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


# calibration

_SCORED = f"{FX}, s AS (SELECT match_id, season, (hg>ag)::INT::DOUBLE AS y, round((1/odds_h)/(1/odds_h+1/odds_d+1/odds_a),2) AS p FROM fx)"


def _scored(spark, sf):
    p = market.novig([F.col("odds_h"), F.col("odds_d"), F.col("odds_a")])[0]
    return fixtures(spark, sf).select("match_id", "season", (F.col("hg") > F.col("ag")).cast("double").alias("y"), F.round(p, 2).alias("p"))


@query(
    f"""WITH {_SCORED}, t AS (SELECT p, sum(y) AS t, count(*) AS w FROM s WHERE season<1998 GROUP BY 1), c AS (SELECT p, sum(t) OVER (ORDER BY p) AS ct, sum(w) OVER (ORDER BY p) AS cw, t, w FROM t),
m AS (SELECT a.p AS a, b.p AS b, (b.ct-a.ct+a.t)/(b.cw-a.cw+a.w) AS mean FROM c a JOIN c b ON a.p<=b.p), n AS (SELECT x.p, m.a, min(m.mean) AS low FROM t x JOIN m ON m.a<=x.p AND m.b>=x.p GROUP BY 1,2), k AS (SELECT p AS x0, max(low) AS v0 FROM n GROUP BY 1),
l AS (SELECT x0, v0, lead(x0) OVER (ORDER BY x0) AS x1, lead(v0) OVER (ORDER BY x0) AS v1 FROM k)
SELECT match_id, round(CASE WHEN x0 IS NULL THEN (SELECT min_by(v0, x0) FROM k) WHEN x1 IS NULL OR x0=s.p THEN v0 ELSE v0+(s.p-x0)/(x1-x0)*(v1-v0) END,6) AS calibrated FROM s ASOF LEFT JOIN l ON s.p>=l.x0 WHERE season=1998"""
)
def isotonic_calibration(spark, sf):
    s = _scored(spark, sf)
    pools = calibration.isotonic(s.where("season < 1998"), F.col("p"), F.col("y"))
    return calibration.recalibrated(s.where("season = 1998"), pools, "p").select("match_id", r6("calibrated").alias("calibrated"))


_STEPS = 12


def _platt_sql() -> str:
    out = [f"WITH {_SCORED}", "z AS (SELECT season, y, p, ln(p/(1-p)) AS x FROM s)", "t0 AS (SELECT 1.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(1, _STEPS + 1):
        out.append(f"u{k} AS (SELECT a, b, sum((q-y)*x) AS g0, sum(q-y) AS g1, sum(q*(1-q)*x*x) AS h00, sum(q*(1-q)*x) AS h01, sum(q*(1-q)) AS h11 FROM (SELECT y, x, a, b, 1/(1+exp(-(a*x+b))) AS q FROM z, t{k - 1} WHERE season<1998) GROUP BY a, b)")
        out.append(f"t{k} AS (SELECT a-(h11*g0-h01*g1)/(h00*h11-h01*h01) AS a, b-(h00*g1-h01*g0)/(h00*h11-h01*h01) AS b FROM u{k})")
    loss = lambda q: f"round(avg(-ln(CASE WHEN y=1 THEN {q} ELSE 1-{q} END)),6)"
    return ",\n".join(out) + f" SELECT round(any_value(a),6) AS slope, round(any_value(b),6) AS intercept, count(*) AS n, {loss('p')} AS log_loss, {loss('(1/(1+exp(-(a*x+b))))')} AS calibrated_log_loss FROM z, t{_STEPS} WHERE season=1998"


@query(_platt_sql())
def platt_calibration(spark, sf):
    s = _scored(spark, sf).withColumn("x", F.ln(F.col("p") / (1 - F.col("p"))))
    a, b = calibration.platt(s.where("season < 1998"), F.col("x"), F.col("y"))
    q = 1 / (1 + F.exp(-(F.lit(a) * F.col("x") + F.lit(b))))
    loss = lambda p: r6(F.avg(-F.ln(F.when(F.col("y") == 1, p).otherwise(1 - p))))
    return s.where("season = 1998").agg(r6(F.lit(a)).alias("slope"), r6(F.lit(b)).alias("intercept"), F.count(F.lit(1)).alias("n"), loss(F.col("p")).alias("log_loss"), loss(q).alias("calibrated_log_loss"))
