"""Recalibration of scores: isotonic by pooled runs, Platt by Newton steps over grouped sums."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POOL = "lo double, hi double, total double, weight double"


def _pooled(lo: np.ndarray, hi: np.ndarray, total: np.ndarray, weight: np.ndarray) -> list[list[float]]:
    """Adjacent violators pooled: sorted pools with rising means from sorted pools with any."""
    stack: list[list[float]] = []
    for pool in zip(lo.tolist(), hi.tolist(), total.tolist(), weight.tolist()):
        stack.append(list(pool))
        while len(stack) > 1 and stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3]:
            _, top, more, heavier = stack.pop()
            stack[-1][1] = top
            stack[-1][2] += more
            stack[-1][3] += heavier
    return stack


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pools of a sorted run, carried from batch to batch."""
    held: list[list[float]] = []
    for b in batches:
        cols = [np.concatenate([[p[k] for p in held], b[c]]) for k, c in enumerate(("lo", "hi", "total", "weight"))]
        held = _pooled(*cols)
    if held:
        yield pd.DataFrame(held, columns=["lo", "hi", "total", "weight"])


def isotonic(df: DataFrame, score: Column, label: Column, weight: Column | None = None, digits: int = 6) -> DataFrame:
    """lo, hi, value, weight: the pools of the least-squares rising step function of label on score.

    Equal scores are summed first, to `digits` places, so that at most 10**digits + 1 scores of [0, 1] are left however many
    rows there are. They are dealt into sorted runs, each run is pooled where it lies, and the pools of the runs, which are
    few, are pooled once more: pooling pools gives what pooling rows gives.
    """
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(F.round(score, digits).alias("lo"), label.cast("double").alias("y"), w.alias("w")).dropna().where("w > 0")
    sums = rows.groupBy("lo").agg(F.sum(F.col("y") * F.col("w")).alias("total"), F.sum("w").alias("weight")).select("lo", F.col("lo").alias("hi"), "total", "weight")
    runs = sums.repartitionByRange("lo").sortWithinPartitions("lo").mapInPandas(_run, POOL)
    pools = runs.groupBy().applyInPandas(lambda pdf: pd.DataFrame(_pooled(*pdf.sort_values("lo")[["lo", "hi", "total", "weight"]].to_numpy(float).T), columns=["lo", "hi", "total", "weight"]), POOL)
    return pools.select("lo", "hi", (F.col("total") / F.col("weight")).alias("value"), "weight")


def recalibrated(df: DataFrame, pools: DataFrame, score: str, name: str = "calibrated") -> DataFrame:
    """df with the value at its score: that of its pool, a straight line between two pools, the end values outside.

    The pools (at most 10**digits + 1) go to every task. NULL for a missing score, and everywhere without pools.
    """
    rows = sorted(pools.select("lo", "hi", "value").collect())
    x = np.array([v for r in rows for v in (r.lo, r.hi)], float)
    y = np.array([v for r in rows for v in (r.value, r.value)], float)

    @F.pandas_udf("double")
    def at(s: pd.Series) -> pd.Series:
        return pd.Series(np.interp(s, x, y), index=s.index).where(s.notna())

    return df.withColumn(name, at(F.col(score).cast("double")) if len(x) else F.lit(None).cast("double"))


def platt(df: DataFrame, logit: Column, label: Column, steps: int = 25, tolerance: float = 1e-10) -> tuple[float, float]:
    """(slope, intercept) of the logistic fit of label on a logit: Newton steps, each one row of sums over all rows.

    From slope 1 and intercept 0 on, until neither moves by more than the tolerance. Stays there without both labels.
    """
    rows = df.select(logit.cast("double").alias("x"), label.cast("double").alias("y")).dropna()
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col("x") + F.lit(b))))
        g, h = p - F.col("y"), p * (1 - p)
        s = rows.agg(F.sum(g * F.col("x")), F.sum(g), F.sum(h * F.col("x") * F.col("x")), F.sum(h * F.col("x")), F.sum(h), F.min("y"), F.max("y")).first()
        if s[0] is None or s[5] == s[6] or not math.isfinite(det := s[2] * s[4] - s[3] * s[3]) or det <= 0:
            break
        da, db = (s[4] * s[0] - s[3] * s[1]) / det, (s[2] * s[1] - s[3] * s[0]) / det
        a, b = a - da, b - db
        if max(abs(da), abs(db)) <= tolerance:
            break
    return a, b
