"""Point-in-time features. A date-group frame never sees the row's own date; a row frame never sees the row itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def day(date: Column) -> Column:
    return F.unix_date(date)


def before_date(keys: list[str], date: str = "match_date") -> WindowSpec:
    """All rows of the keys on strictly earlier dates."""
    return Window.partitionBy(*keys).orderBy(day(F.col(date))).rangeBetween(Window.unboundedPreceding, -1)


def last_days(keys: list[str], n: int, date: str = "match_date") -> WindowSpec:
    """Rows of the keys in [date - n, date)."""
    return Window.partitionBy(*keys).orderBy(day(F.col(date))).rangeBetween(-n, -1)


def prior_rows(keys: list[str], order: list[str], n: int | None = None) -> WindowSpec:
    """The n rows before this one (all without n), in a total order."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def rest_days(keys: list[str], default: int = 14, date: str = "match_date") -> Column:
    return F.coalesce(day(F.col(date)) - F.max(day(F.col(date))).over(before_date(keys, date)), F.lit(default))


def last_n(df: DataFrame, value: str, keys: list[str], n: int, tie: list[str], name: str, date: str = "match_date") -> DataFrame:
    """Adds name: the value's last n entries on strictly earlier dates, oldest first; shorter histories give shorter arrays.

    A frame of n rows, taken at the first row of each date: no row holds more than n entries of its history.
    """
    frame = prior_rows(keys, [date, *tie], n)
    own = Window.partitionBy(*keys, date).orderBy(*tie).rowsBetween(Window.unboundedPreceding, 0)
    held = df.withColumn("__last", F.collect_list(F.struct(F.col(value).alias("v"))).over(frame))
    return held.withColumn(name, F.transform(F.first("__last").over(own), lambda s: s["v"])).drop("__last")


def last_means(df: DataFrame, values: dict[str, Column], keys: list[str], n: int, tie: list[str], name: str, date: str = "match_date") -> DataFrame:
    """Adds name: a struct with the mean of each value over the last n rows on strictly earlier dates; NULL without any."""
    frame = prior_rows(keys, [date, *tie], n)
    own = Window.partitionBy(*keys, date).orderBy(*tie).rowsBetween(Window.unboundedPreceding, 0)
    held = df.withColumn("__last", F.struct(*[F.avg(v).over(frame).alias(k) for k, v in values.items()]))
    return held.withColumn(name, F.first("__last").over(own)).drop("__last")


def lagged_history(history: DataFrame, keys: list[str], date: str, tie: list[str], values: list[str], widths: list[int]) -> DataFrame:
    """history with what a later row may know of it: entries so far, and of the last w (this one counted) how many and the means.

    Joined to other rows by a strict as-of join on the date, this is each row's lagged history in a second table.
    """
    run = Window.partitionBy(*keys).orderBy(date, *tie)
    last = lambda w: run.rowsBetween(1 - w, 0)
    stats = [F.row_number().over(run).cast("long").alias("history_count")]
    for w in widths:
        stats += [F.count(F.lit(1)).over(last(w)).alias(f"matches_w{w}"), *[F.avg(v).over(last(w)).alias(f"{v}_avg_w{w}") for v in values]]
    return history.select(*keys, date, *tie, *stats)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def padded(values: Column, n: int) -> Column:
    """Left-padded with zeros to n."""
    return F.concat(F.array_repeat(F.lit(0.0), n - F.size(values)), F.transform(values, lambda x: x.cast("double")))


def rolling_mean(value: str, keys: list[str], order: list[str], n: int, least: int = 1) -> Column:
    """Mean of the n rows before, where at least `least` of them have a value."""
    w = prior_rows(keys, order, n)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def drawdown(df: DataFrame, keys: list[str], order: list[str], profit: str, version: int = 1) -> DataFrame:
    """keys + max_drawdown of the running sum of profit (NULL counts 0).

    1: largest fall from the running peak, at least 0; 2: the same, negative; 3: the peak starts at 0, the bankroll.
    """
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = df.withColumn("__c", F.sum(F.coalesce(F.col(profit), F.lit(0.0))).over(run))
    peak = F.max("__c").over(run)
    fall = total.withColumn("__d", (F.greatest(peak, F.lit(0.0)) if version == 3 else peak) - F.col("__c"))
    return fall.groupBy(*keys).agg((F.max("__d") if version != 2 else -F.max("__d")).alias("max_drawdown"))


def losing_streak(df: DataFrame, keys: list[str], order: list[str], profit: str) -> DataFrame:
    """keys + longest run of rows with a loss (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    loss = F.coalesce(F.col(profit) < 0, F.lit(False))
    marked = df.withColumn("__l", loss).withColumn("__i", F.row_number().over(w) - F.sum(F.col("__l").cast("int")).over(w))
    runs = marked.where("__l").groupBy(*keys, "__i").agg(F.count(F.lit(1)).alias("__n")).groupBy(*keys).agg(F.max("__n").alias("__m"))
    return df.select(*keys).distinct().join(runs, keys, "left").select(*keys, F.coalesce("__m", F.lit(0)).cast("long").alias("longest_losing_streak"))
