"""Anomalies between the files of an archive: each a row of anomaly, severity, place and how many rows it concerns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANOMALY = ("anomaly", "severity", "place", "affected_rows", "details")


def _row(name: str, severity: str, place: list[Column], rows: Column, details: Column) -> list[Column]:
    return [F.lit(name).alias("anomaly"), F.lit(severity).alias("severity"), F.concat_ws("|", *[p.cast("string") for p in place]).alias("place"), rows.cast("long").alias("affected_rows"), details.alias("details")]


def score_conflicts(fixtures: DataFrame, keys: list[str], score: list[str], file: str) -> DataFrame:
    """Fixtures (keys) for which files give different scores; rows without a full score say nothing."""
    known = F.struct(*score)
    whole = ~F.greatest(*[F.col(c).isNull() for c in score])
    g = fixtures.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(whole, known)).alias("k"), F.array_join(F.sort_array(F.collect_set(file)), "|").alias("files")).where("k > 1")
    return g.select(*_row("inconsistent_score_rows", "error", [F.col(k) for k in keys], F.col("n"), F.concat(F.col("k").cast("string"), F.lit(" scores in "), F.col("files"))))


def meaning_changes(inventory: DataFrame, keys: list[str], meaning: list[str]) -> DataFrame:
    """Columns (keys) that mean different things in different files."""
    g = inventory.groupBy(*keys).agg(F.count_distinct(F.struct(*meaning)).alias("k")).where("k > 1")
    return g.select(*_row("column_meaning_changed", "blocker", [F.col(k) for k in keys], F.col("k"), F.lit("")))


def members_changed(inventory: DataFrame, place: str, season: str, member: str) -> DataFrame:
    """Seasons of a place whose members (bookmakers, for one) are not those of the place's season before.

    A member's seasons are ranked within its place, so that coming and going is a comparison of neighbours: sets are never
    held whole. details: how many came and how many went.
    """
    own = inventory.where(F.col(member).isNotNull() & F.col(season).isNotNull()).select(place, season, member).distinct()
    seasons = own.select(place, season).distinct().withColumn("__k", F.row_number().over(Window.partitionBy(place).orderBy(season)))
    at = own.join(seasons, [place, season])
    w = Window.partitionBy(place, member).orderBy("__k")
    last = F.max("__k").over(Window.partitionBy(place))
    near = at.withColumn("__last", last).withColumn("__before", F.lag("__k").over(w)).withColumn("__after", F.lead("__k").over(w))
    came = near.where((F.col("__k") > 1) & (F.coalesce("__before", F.lit(0)) != F.col("__k") - 1)).select(place, "__k", F.lit(1).alias("came"), F.lit(0).alias("went"))
    went = near.where((F.col("__k") < F.col("__last")) & (F.coalesce("__after", F.lit(0)) != F.col("__k") + 1)).select(place, (F.col("__k") + 1).alias("__k"), F.lit(0).alias("came"), F.lit(1).alias("went"))
    g = came.unionByName(went).groupBy(place, "__k").agg(F.sum("came").alias("came"), F.sum("went").alias("went")).join(seasons, [place, "__k"])
    return g.select(*_row("members_appeared_or_disappeared", "info", [F.col(place), F.col(season)], F.col("came") + F.col("went"), F.concat(F.lit("+"), F.col("came").cast("string"), F.lit(" -"), F.col("went").cast("string"))))


def one_sided(prices: DataFrame, place: list[str], opening: Column, closing: Column) -> DataFrame:
    """Places with closing prices that no opening backs, and with openings that never close."""
    g = prices.groupBy(*place).agg(F.count_if(closing & ~opening).alias("c"), F.count_if(opening & ~closing).alias("o"))
    at = [F.col(p) for p in place]
    closed = g.where("c > 0").select(*_row("closing_without_opening", "blocker", at, F.col("c"), F.lit("")))
    return closed.unionByName(g.where("o > 0").select(*_row("opening_without_closing", "warning", at, F.col("o"), F.lit(""))))
