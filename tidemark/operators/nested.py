"""Nested selection of features and settings from sums of squares and products.

A ridge fit, its squared error on any rows and its blend with the market all follow from one matrix of sums. Rows are
read once, into such a matrix per year; every feature set, penalty, blend and fold is then solved from those, without
reading rows again.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def year_sums(df: DataFrame, year: str, features: list[str], residual: Column) -> DataFrame:
    """year, n and `sums`: of the products of features and residual (upper triangle by rows, the residual last).

    Rows in which one of them is missing are left out.
    """
    cols = [*[F.col(c).cast("double") for c in features], residual.cast("double")]
    rows = df.select(F.col(year).cast("int").alias("year"), *[c.alias(f"x{i}") for i, c in enumerate(cols)]).dropna()
    pairs = itertools.combinations_with_replacement(range(len(cols)), 2)
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).alias("sums"))


SCORES = "year int, n bigint, feature_set string, reg double, alpha double, delta double"


def _scorer(features: list[str], sets: dict[str, list[str]], regs: list[float], alphas: list[float], min_train: int):
    k = len(features) + 1
    upper = np.triu_indices(k)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("year")
        grams = []
        for s in pdf["sums"]:
            m = np.zeros((k, k))
            m[upper] = s
            grams.append(m + np.triu(m, 1).T)
        out, past = [], np.zeros((k, k))
        for at, (year, n, gram) in enumerate(zip(pdf["year"], pdf["n"], grams)):
            if at >= min_train:
                for (name, columns), reg in itertools.product(sets.items(), regs):
                    ix = [features.index(c) for c in columns]
                    own = np.ix_(ix, ix)
                    w = np.linalg.lstsq(past[own] + reg * np.eye(len(ix)), past[ix, -1], rcond=None)[0]
                    square, product = w @ gram[own] @ w, w @ gram[ix, -1]
                    out += [(year, n, name, reg, a, (a * a * square - 2 * a * product) / n) for a in alphas]
            past = past + gram
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCORES.split(", ")])

    return run


def candidate_scores(sums: DataFrame, features: list[str], sets: dict[str, list[str]], regs: list[float], alphas: list[float], min_train: int) -> DataFrame:
    """SCORES of each year with at least min_train years before it: the mean squared error of market + alpha * w x less the
    market's own, w being the ridge fit of the residual on all earlier years. One row a year meets in one task."""
    return sums.groupBy().applyInPandas(_scorer(features, sets, regs, alphas, min_train), SCORES)


def nested_selection(df: DataFrame, year: str, features: list[str], residual: Column, sets: dict[str, list[str]], regs: list[float], alphas: list[float], min_train: int = 1) -> DataFrame:
    """test_year, feature_set, reg, alpha, validations, validation_delta, n, test_delta.

    For a test year the setting of least mean delta over the validation years before it is taken (ties: smaller alpha, larger
    reg, then the name), refitted on all years before, and judged on the test year, which no choice has seen.
    """
    scores = candidate_scores(year_sums(df, year, features, residual), features, sets, regs, alphas, min_train)
    before = Window.partitionBy("feature_set", "reg", "alpha").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    seen = scores.withColumn("validations", F.count("delta").over(before)).withColumn("validation_delta", F.avg("delta").over(before)).where("validations > 0")
    order = F.struct(F.round("validation_delta", 12), "alpha", -F.col("reg"), "feature_set")
    best = seen.groupBy(F.col("year").alias("test_year")).agg(F.min_by(F.struct("feature_set", "reg", "alpha", "validations", "validation_delta", "n", F.col("delta").alias("test_delta")), order).alias("b"))
    return best.select("test_year", "b.*")
