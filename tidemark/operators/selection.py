"""Folds, gates, rules, controls and decisions between a model and the market."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# folds


def positional_folds(years: list[int]) -> list[dict[str, object]]:
    """Folds by position: all but the last three years up to i train, then tune, calibration and test; the first at i = 3."""
    ys = sorted(set(years))
    return [{"fold": k + 1, "train": ys[:i - 2], "tune": ys[i - 2], "calibration": ys[i - 1], "test": ys[i]} for k, i in enumerate(range(3, len(ys)))]


def expanding_partition(years: list[int], test: int, purge: int = 0) -> dict[str, list[int]]:
    """Train on all years before test - purge, the last of them set aside for calibration if there are two; an error
    without history."""
    before = [y for y in sorted(set(years)) if y < test - purge]
    if not before or test not in set(years):
        raise ValueError(f"no history before {test}")
    return {"train": before[:-1] if len(before) > 1 else before, "calibration": before[-1:] if len(before) > 1 else [], "test": [test]}


def fold_sizes(counts: DataFrame, year: str, n: str, folds: list[dict]) -> DataFrame:
    """fold, role, rows of folds given as dicts of year lists, from one count per year: rows are never read per fold."""
    flat = [(f.get("fold", k + 1), role, y) for k, f in enumerate(folds) for role, ys in f.items() if role != "fold" for y in (ys if isinstance(ys, list) else [ys])]
    plan = F.array(*[F.struct(F.lit(a).alias("fold"), F.lit(b).alias("role"), F.lit(c).alias("y")) for a, b, c in flat])
    rows = counts.select(F.explode(plan).alias("p"), year, n).where(F.col("p.y") == F.col(year))
    return rows.groupBy(F.col("p.fold").alias("fold"), F.col("p.role").alias("role")).agg(F.sum(n).alias("rows"))


# gates and decisions


def predictive_gate(metrics: DataFrame, log_loss: float = 0.0, brier: float = 0.0005, ece: float = 0.01) -> DataFrame:
    """metrics (.., model_* and market_* of log_loss, brier, ece, accuracy) with delta_* and passed.

    The log loss must fall by more than the first bound, Brier and calibration error may rise by theirs.
    """
    names = ("log_loss", "brier", "ece", "accuracy")
    out = metrics.withColumns({f"delta_{m}": F.col(f"model_{m}") - F.col(f"market_{m}") for m in names})
    return out.withColumn("passed", (F.col("delta_log_loss") < log_loss) & (F.col("delta_brier") <= brier) & (F.col("delta_ece") <= ece))


def best_setting(scores: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Per key the (alpha, temperature) of least log loss, then Brier, then alpha, then distance of the temperature from 1."""
    order = F.struct("logloss", "brier", "alpha", F.abs(F.col("temperature") - 1))
    return scores.groupBy(*keys).agg(F.min_by(F.struct("alpha", "temperature", "logloss", "brier"), order).alias("best")).select(*keys, "best.*")


def decision(bets: Column, profit: Column, roi: Column, z: Column, years: Column, best_year: Column, best_league: Column, without_best_year: Column, best_control: Column) -> Column:
    """The status of a rule; the first gate that it fails decides."""
    weak = (bets == 0) | (profit <= 0) | (roi <= 0.02) | (z < 1.0) | (years < 4)
    narrow = (best_year > 0.5 * profit) | (best_league > 0.5 * profit) | (without_best_year <= 0) | (best_control >= profit)
    return F.when(F.coalesce(weak, F.lit(True)), "predictive_only_no_value").when(F.coalesce(narrow, F.lit(False)), "research_only").otherwise("forward_paper_candidate")


def contract_hash(config: dict) -> str:
    """SHA-256 of a configuration, keys sorted."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def assert_contract(config: dict, expected: str) -> None:
    if (found := contract_hash(config)) != expected:
        raise ValueError(f"the contract changed: {found} instead of {expected}")


# rules


def side_rows(df: DataFrame, keep: list[str], sides: dict[str, dict[str, Column]]) -> DataFrame:
    """One row per side in one pass: keep, side and the given columns of each."""
    return df.select(*keep, F.inline(F.array(*[F.struct(F.lit(s).alias("side"), *[c.alias(n) for n, c in cols.items()]) for s, cols in sides.items()])))


def best_side(rows: DataFrame, key: str, valid: Column, edge: str = "edge") -> DataFrame:
    """Of each key's valid sides the one with the largest edge; ties go to the first side of the alphabet."""
    w = Window.partitionBy(key).orderBy(F.round(edge, 12).desc(), "side")
    return rows.where(valid).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def rules_met(rules: dict[str, tuple[str, ...]], conditions: dict[str, Column]) -> Column:
    """The names of the rules all of whose conditions hold of a row; a condition that is NULL does not hold.

    rules: name to the names of its conditions; conditions: what each of those asks. A rule is data: a new one is a new
    entry, and no name has a meaning.
    """
    known = {c: F.coalesce(x, F.lit(False)) for c, x in conditions.items()}
    return F.array_compact(F.array(*[F.when(F.forall(F.array(*[known[c] for c in needs]), lambda x: x), F.lit(name)) for name, needs in rules.items()]))


def line_candidates(df: DataFrame, home_line: str, away_line: str, odds: str, threshold: float) -> DataFrame:
    """Rows whose home line is at most the threshold or whose away line is at least its size, at valid away odds."""
    return df.where((F.col(odds) > 1) & ((F.col(home_line) <= threshold) | (F.col(away_line) >= abs(threshold))))


def scope(df: DataFrame, name: str, league: str, season: str, covered: str, lower: list[str], modern: int = 2014) -> DataFrame:
    """Rows of a named scope: all with a season, covered ones, top divisions, or modern covered ones."""
    has = F.col(season).isNotNull()
    own = F.coalesce(F.col(covered), F.lit(False))
    masks = {"full": has, "covered": has & own, "top": has & ~F.col(league).isin(lower), "modern_covered": has & own & (F.col(season) >= modern)}
    if name not in masks:
        raise ValueError(f"unknown scope {name}")
    return df.where(masks[name])


def truthy(x: Column) -> Column:
    """Text as a boolean: true, 1 and yes in any case; everything else, NULL too, is false."""
    return F.coalesce(F.lower(x.cast("string")).isin("true", "1", "yes"), F.lit(False))


def opposite(side: Column) -> Column:
    return F.when(side == "home", "away").when(side == "away", "home")


# controls


def _digits(text: Column, n: int) -> Column:
    """The first n hex digits of the SHA-256 of a text as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, n), 16, 10).cast("long")


def same_size(pool: DataFrame, sizes: DataFrame, strata: list[str], row_id: str, salt: str) -> DataFrame:
    """As many rows of each stratum as `sizes` (strata, n) says, by the SHA-256 of a salt and the row's id."""
    w = Window.partitionBy(*strata).orderBy(F.sha2(F.concat(F.lit(salt), F.col(row_id).cast("string")), 256), row_id)
    return pool.withColumn("__r", F.row_number().over(w)).join(sizes, strata).where(F.col("__r") <= F.col("n")).drop("__r", "n")


def shuffled(df: DataFrame, value: str, row_id: str, keys: list[str], salt: str) -> DataFrame:
    """value exchanged between rows of the same keys: the row of rank r by id gets that of rank r by a salted hash.

    Without keys rows change places within 1,024 shares, dealt by a hash of the id, so that no task sees all rows.
    """
    h = F.sha2(F.concat(F.lit(salt), F.col(row_id).cast("string")), 256)
    if not keys:
        df, keys = df.withColumn("__share", _digits(F.col(row_id).cast("string"), 5) % 1024), ["__share"]
    a = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(row_id))).drop(value)
    b = df.select(*keys, value, F.row_number().over(Window.partitionBy(*keys).orderBy(h, row_id)).alias("__r"))
    return a.join(b, [*keys, "__r"]).drop("__r", "__share")


def noise_replaced(df: DataFrame, columns: list[str], fitted: Column, row_id: str, salt: str) -> DataFrame:
    """columns filled with normal noise of the mean and spread that they have where `fitted` holds (1 without any).

    The noise is made of salted hashes of the row's id and the column's name, so it is the same in every run and order.
    """
    stats = df.agg(*[F.avg(F.when(fitted, F.col(c))).alias(f"__m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(F.when(fitted, F.col(c))).alias(f"__s{i}") for i, c in enumerate(columns)])
    unit = lambda c, k: (_digits(F.concat_ws("-", F.lit(f"{salt}-{c}-{k}"), F.col(row_id).cast("string")), 12) + 0.5) / float(1 << 48)
    normal = lambda c: F.sqrt(-2 * F.ln(unit(c, 1))) * F.cos(2 * math.pi * unit(c, 2))
    spread = lambda i: F.when(F.col(f"__s{i}") > 0, F.col(f"__s{i}")).otherwise(1.0)
    made = {c: F.coalesce(f"__m{i}", F.lit(0.0)) + spread(i) * normal(c) for i, c in enumerate(columns)}
    return df.crossJoin(F.broadcast(stats)).withColumns(made).select(*df.columns)  # stats is one row


# resampling


def block_bootstrap(df: DataFrame, block: str, sums: dict[str, Column], iterations: int = 500, salt: str = "17") -> DataFrame:
    """replicate and the sums over as many blocks as there are, drawn with replacement.

    Rows become one row of sums per block. The draws are slots (replicate, place) whose block is a salted SHA-256 modulo the
    number of blocks: they are made, joined and summed on the cluster, and the same everywhere.
    """
    g = df.groupBy(block).agg(*[v.alias(k) for k, v in sums.items()])
    g = g.withColumn("__i", F.row_number().over(Window.orderBy(block)) - 1)  # one row per block
    n = g.agg(F.count(F.lit(1)).alias("__n"))
    spark = df.sparkSession
    slots = spark.range(iterations).select(F.col("id").alias("replicate")).crossJoin(F.broadcast(n))  # n is one row
    slots = slots.select("replicate", "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__slot"))
    draw = _digits(F.concat_ws("-", F.lit(salt), "replicate", "__slot"), 12) % F.col("__n")
    drawn = slots.select("replicate", draw.alias("__i")).groupBy("replicate", "__i").agg(F.count(F.lit(1)).alias("__times"))
    return drawn.join(g, "__i").groupBy("replicate").agg(*[F.sum(F.col(k) * F.col("__times")).alias(k) for k in sums])

