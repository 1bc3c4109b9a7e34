"""Metrics, calibration, folds, selection and controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_loss(p: Column, y: Column, eps: float = 1e-15) -> Column:
    c = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-F.ln(F.when(y == 1, c).otherwise(1 - c)))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def multiclass_log_loss(ps: list[Column], y: Column, eps: float = 1e-15) -> Column:
    own = F.coalesce(*[F.when(y == k, p) for k, p in enumerate(ps)])
    return F.avg(-F.ln(F.greatest(own, F.lit(eps))))


def multiclass_brier(ps: list[Column], y: Column, mean: bool = False) -> Column:
    """Sum over classes, or with `mean` the mean of one-versus-rest."""
    total = sum((F.pow(p - (y == k).cast("double"), 2) for k, p in enumerate(ps)), F.lit(0.0))
    return F.avg(total / (len(ps) if mean else 1))


def bin_left(p: Column, n: int) -> Column:
    """[lo, hi) bins, the last closed."""
    return F.least(F.floor(p * n), F.lit(n - 1))


def bin_right(p: Column, n: int) -> Column:
    """(lo, hi] bins, the first with its lower edge."""
    return F.greatest(F.ceil(p * n) - 1, F.lit(0))


def calibration_error(df: DataFrame, keys: list[str], conf: Column, hit: Column, bins: Column) -> DataFrame:
    """keys + ece: share-weighted gap of mean confidence and accuracy over bins; two small aggregations."""
    g = df.groupBy(*keys, bins.alias("__b")).agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("c"), F.avg(hit.cast("double")).alias("a"))
    return g.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def z_score(profit: str) -> Column:
    """sum / (sd * sqrt(n)), 0 where undefined."""
    return F.coalesce(F.try_divide(F.sum(profit), F.stddev_samp(profit) * F.sqrt(F.count(profit))), F.lit(0.0))


def bet_summary(df: DataFrame, keys: list[str], profit: str = "profit") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bets"), F.count_if(F.col(profit) > 0).alias("wins"), F.coalesce(F.sum(profit), F.lit(0.0)).alias("profit"), F.coalesce(F.avg(profit), F.lit(0.0)).alias("roi"), z_score(profit).alias("z")
    )


def concentration(df: DataFrame, keys: list[str], unit: str, value: str) -> DataFrame:
    """keys + hhi of the units' shares and the largest share; NULL where the total is about 0."""
    g = df.groupBy(*keys, unit).agg(F.sum(value).alias("v"))
    t = F.sum("v").over(Window.partitionBy(*keys))
    share = F.when(F.abs(t) > 1e-12, F.col("v") / t)
    return g.withColumn("s", share).groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("hhi"), F.max("s").alias("top_share"))


def rule_grid(bets: DataFrame, rules: DataFrame, cond: Column, profit: str = "profit") -> DataFrame:
    """Metrics of every rule of a small grid (rule_id, ..) over bets; the grid is broadcast once its rows are known to be few."""
    if rules.limit(10_001).count() > 10_000:
        raise ValueError("a rule grid holds at most 10,000 rules")
    return bet_summary(bets.join(F.broadcast(rules), cond), ["rule_id"], profit)


def select_rule(metrics: DataFrame, gates: Column, order: list[Column]) -> DataFrame:
    """The best gated rule; none if no rule passes."""
    return metrics.where(gates).orderBy(*order).limit(1)


def walk_forward(years: list[int], min_train: int) -> list[int]:
    return sorted(set(years))[min_train:]


def nested_roles(df: DataFrame, folds: list[int], year: str, date: str) -> DataFrame:
    """fold, role and the row, for train / tune / calibration / test with purged boundaries.

    test = fold year, calibration = fold - 1, tune = fold - 2, train earlier. Rows on or after the first date of the next
    (already purged) part are dropped, from the test backwards. All bounds come from one grouped minimum per fold and role.
    """
    f = df.select("*", F.explode(F.array(*[F.lit(y) for y in folds])).alias("fold")).where(F.col(year) <= F.col("fold"))
    f = f.withColumn("role", F.when(F.col(year) == F.col("fold"), "test").when(F.col(year) == F.col("fold") - 1, "calibration").when(F.col(year) == F.col("fold") - 2, "tune").otherwise("train"))
    first = {r: F.min(F.when(F.col("role") == r, F.col(date))) for r in ("test", "calibration", "tune")}
    starts = f.groupBy("fold").agg(*[v.alias(r) for r, v in first.items()])
    # of a purged part only dates before its bound are left, so its first date is its own or there is none
    kept = lambda part, bound: F.when(bound.isNull() | (part < bound), part)
    calibration = kept(F.col("calibration"), F.col("test"))
    starts = starts.select("fold", F.col("test").alias("__test"), calibration.alias("__calibration"), kept(F.col("tune"), calibration).alias("__tune"))
    bound = F.when(F.col("role") == "calibration", F.col("__test")).when(F.col("role") == "tune", F.col("__calibration")).when(F.col("role") == "train", F.col("__tune"))
    f = f.join(F.broadcast(starts), "fold")  # one row for each of the given folds
    return f.where(bound.isNull() | (F.col(date) < bound)).drop("__test", "__calibration", "__tune")


def leakage_report(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, status and violations, from one aggregation over df."""
    agg = df.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("violations")) for k in checks])
    return agg.select(F.inline(rows)).select("check", F.when(F.col("violations") == 0, "pass").otherwise("fail").alias("status"), "violations")


def leave_one_out(df: DataFrame, group: str, profit: str = "profit") -> DataFrame:
    """Bets and profit without each group: totals less the group's, from one aggregation."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(profit).alias("p"))
    w = Window.partitionBy()
    return g.select(F.col(group).alias("excluded"), (F.sum("n").over(w) - F.col("n")).alias("bets"), (F.sum("p").over(w) - F.col("p")).alias("profit"))
