"""Replay of a price stream in batch: state as of cutoffs, in-play exclusion, staleness and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import leakage_report
from .joins import asof

#: market, runner, ts, pos (order within a time), price, in_play
Stream = DataFrame


def eligible(stream: Stream, start: Column | None = None) -> Stream:
    """Updates before the start and while the last known in-play flag is false; the flag may flip back."""
    w = Window.partitionBy("market").orderBy("ts", "pos").rowsBetween(Window.unboundedPreceding, 0)
    s = stream.withColumn("__p", F.coalesce(F.last("in_play", ignorenulls=True).over(w), F.lit(False))).where(~F.col("__p")).drop("__p")
    return s if start is None else s.where(F.col("ts") < start)


def cutoff_panel(stream: Stream, cutoffs: DataFrame, runners: int) -> DataFrame:
    """(market, cutoff, runner, price, age_s): last price above 1 at or before each cutoff (market, cutoff), for cutoffs at
    which all runners have one."""
    prices = stream.where(F.col("price") > 1)
    grid = cutoffs.join(prices.select("market", "runner").distinct(), "market")
    got = asof(grid, prices, ["market", "runner"], "cutoff", "ts", ["price"], strict=False, tie=["pos"]).where(F.col("price").isNotNull())
    full = got.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("market", "cutoff"))).where(F.col("__n") == runners)
    age = (F.unix_micros(F.col("cutoff").cast("timestamp")) - F.unix_micros(F.col("matched_ts").cast("timestamp"))) / 1_000_000
    return full.select("market", "cutoff", "runner", "price", age.alias("age_s"))


def last_preplay(stream: Stream) -> DataFrame:
    """The last eligible price above 1 of every market and runner."""
    return eligible(stream).where(F.col("price") > 1).groupBy("market", "runner").agg(F.max_by("price", F.struct("ts", "pos")).alias("price"), F.max("ts").alias("ts"))


def path_features(stream: Stream, keys: list[str]) -> DataFrame:
    """Per row: change, volatility of changes so far, running range and distance to it, earlier prices."""
    w = Window.partitionBy(*keys).orderBy("ts", "pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    s = stream.withColumn("change", F.col("price") - F.lag("price").over(w))
    hi, lo = F.max("price").over(run), F.min("price").over(run)
    return s.select("*", F.stddev_pop("change").over(run).alias("volatility"), (hi - lo).alias("range"), (hi - F.col("price")).alias("below_high"), (F.col("price") - lo).alias("above_low"), (F.count("price").over(run) - 1).alias("n_before"))


def order_faults(stream: Stream) -> DataFrame:
    """market, updates, and how many came with an earlier time than the one before, or without a time."""
    w = Window.partitionBy("market").orderBy("line_no")
    return stream.withColumn("__b", F.col("ts") < F.lag("ts").over(w)).groupBy("market").agg(F.count(F.lit(1)).alias("updates"), F.count_if(F.coalesce("__b", F.lit(False))).alias("non_monotonic"), F.count_if(F.col("ts").isNull()).alias("missing_ts"))


def cutoff_audit(panel: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """check, status, violations of a cutoff panel (cutoff, start, price, age_s): what must hold of every row, and `more`."""
    checks = {"prices_above_one": ~(F.col("price") > 1), "nonnegative_staleness": F.col("age_s") < 0, "strictly_before_start": F.col("cutoff") >= F.col("start")}
    return leakage_report(panel, checks | (more or {}))
