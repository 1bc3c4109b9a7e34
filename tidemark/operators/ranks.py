"""Ranks over a whole table or a large key without a window in one task.

Rows are dealt into sorted ranges; a row's rank is its place in its range plus the sizes of the ranges before. Only one
count per range and key is put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.cuts import cut


def ranked(df: DataFrame, order: list, keys: list[str] = (), name: str = "rank", total: str | None = None) -> DataFrame:
    """df with the rank of each row, from 1, in the order given, within its keys if there are any; with `total` also the
    rows of its keys.

    order: columns or sort expressions (nulls first unless they say otherwise); rows that it leaves equal are ranked in
    no particular order. NULL keys are a key. The sorted ranges are written once, so that ranks and sizes are of the same
    ranges. A key with a large share of all rows is as many ranges as it needs.
    """
    by = [*keys, *order]
    at = F.monotonically_increasing_id()  # the range's number, and the place in it
    rows = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", at), "ranks")
    rows = rows.withColumn("__range", F.shiftright("__at", 33)).withColumn("__place", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    parts = rows.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"), (before - F.col("__first") + 1).alias("__shift"), F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"))
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = rows.join(parts, same).withColumn(name, F.col("__place") + F.col("__shift"))
    return out.select(*df.columns, name, *([F.col("__total").alias(total)] if total else []))
