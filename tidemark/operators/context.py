"""Filters that compose, first valid values, checked feature blocks, order checks and staleness."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import validated_join


def first_valid(columns: list[Column], valid=lambda x: x.isNotNull()) -> Column:
    """The first column, in order of priority, that is valid; NULL without one."""
    return F.coalesce(*[F.when(valid(c), c) for c in columns])


def required(df: DataFrame, columns: list[str], positive: list[str] = ()) -> DataFrame:
    """Rows in which every column is there (no NULL, NaN or blank text) and those of `positive` are above 0."""
    kinds = dict(df.dtypes)

    def there(c: str) -> Column:
        x = F.col(c).isNotNull()
        if kinds[c] in ("double", "float"):
            x = x & ~F.isnan(c)
        return x & (F.trim(c) != "") if kinds[c] == "string" else x

    return df.where(functools.reduce(Column.__and__, [*[there(c) for c in columns], *[F.col(c) > 0 for c in positive]], F.lit(True)))


def context_counts(df: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """filter, rows, kept, kept_so_far: each filter alone, and all up to it in the order given; one pass."""
    held, soon = F.lit(True), []
    for c in filters.values():
        held = held & F.coalesce(c, F.lit(False))
        soon.append(held)
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"a{i}") for i, c in enumerate(filters.values())], *[F.count_if(c).alias(f"b{i}") for i, c in enumerate(soon)])
    return one.select("rows", F.inline(F.array(*[F.struct(F.lit(n).alias("filter"), F.col(f"a{i}").alias("kept"), F.col(f"b{i}").alias("kept_so_far")) for i, n in enumerate(filters)]))).select("filter", "rows", "kept", "kept_so_far")


def feature_block(base: DataFrame, block: DataFrame, on: list[str], prefix: str) -> DataFrame:
    """base with the block's columns under a prefix, and has_<prefix>. The block must have a row a key at most, else
    CardinalityError; so no row of base is lost or doubled."""
    own = [c for c in block.columns if c not in on]
    named = block.select(*on, *[F.col(c).alias(f"{prefix}_{c}") for c in own], F.lit(True).alias(f"has_{prefix}"))
    return validated_join(base, named, on, "left", "many_to_one").withColumn(f"has_{prefix}", F.coalesce(f"has_{prefix}", F.lit(False)))


def order_checks(df: DataFrame, fold: str, role: str, roles: list[str], date: str, season: str) -> DataFrame:
    """fold, earlier, later, dates_apart, seasons_apart for neighbouring roles of each fold: whether all of the one lies
    before all of the other. From one minimum and maximum a fold and role."""
    ends = df.groupBy(F.col(fold).alias("fold")).agg(*[f(F.when(F.col(role) == r, F.col(c))).alias(f"{n}{k}{i}") for i, r in enumerate(roles) for n, c in (("d", date), ("s", season)) for k, f in (("lo", F.min), ("hi", F.max))])
    pairs = [F.struct(F.lit(a).alias("earlier"), F.lit(b).alias("later"), (F.col(f"dhi{i}") < F.col(f"dlo{i + 1}")).alias("dates_apart"), (F.col(f"shi{i}") < F.col(f"slo{i + 1}")).alias("seasons_apart")) for i, (a, b) in enumerate(zip(roles, roles[1:]))]
    return ends.select("fold", F.inline(F.array(*pairs)))


class OrderError(ValueError):
    """A later part of a fold begins before an earlier one has ended."""


def assert_order(checks: DataFrame) -> None:
    """Raise OrderError on the first pair of order_checks that overlaps; pairs with an empty side are in order."""
    bad = checks.where(~F.coalesce("dates_apart", F.lit(True)) | ~F.coalesce("seasons_apart", F.lit(True))).limit(1).collect()
    if bad:
        raise OrderError(f"fold {bad[0].fold}: {bad[0].later} begins before {bad[0].earlier} ends")


def staleness(df: DataFrame, keys: list[str], age: Column, edges: list[float]) -> DataFrame:
    """keys, segment, rows: how old values are, in segments (a, b] of the edges; `missing` without an age."""
    names = [f"<= {edges[0]:g}", *[f"({a:g}, {b:g}]" for a, b in zip(edges, edges[1:])], f"> {edges[-1]:g}"]
    at = F.when(age.isNull(), "missing")
    for e, n in zip(edges, names):
        at = at.when(age <= e, n)
    return df.groupBy(*keys, at.otherwise(names[-1]).alias("segment")).agg(F.count(F.lit(1)).alias("rows"))


def standardised(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """df with <column>_z (missing values filled with the median, then centred and scaled) and <column>_missing; median,
    mean and spread (1 where there is none) are those of the train rows. One aggregation for the medians, one for the rest."""
    medians = df.agg(*[F.percentile(F.when(train, F.col(c)), F.lit(0.5)).alias(f"__d{i}") for i, c in enumerate(columns)])
    filled = df.crossJoin(F.broadcast(medians)).withColumns({f"__f{i}": F.coalesce(F.col(c).cast("double"), F.col(f"__d{i}")) for i, c in enumerate(columns)})  # medians are one row
    stats = filled.agg(*[f(F.when(train, F.col(f"__f{i}"))).alias(f"__{n}{i}") for i in range(len(columns)) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scale = lambda i: F.when(F.col(f"__s{i}") > 0, F.col(f"__s{i}")).otherwise(1.0)
    z = {f"{c}_z": (F.col(f"__f{i}") - F.col(f"__m{i}")) / scale(i) for i, c in enumerate(columns)} | {f"{c}_missing": F.col(c).isNull() for c in columns}
    return filled.crossJoin(F.broadcast(stats)).withColumns(z).select(*df.columns, *z)  # stats are one row
