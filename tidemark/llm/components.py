"""Connected components of an edge list, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import few, written


def _with_low(rows: DataFrame, low: DataFrame, edges: int, fan: int) -> DataFrame:
    """rows (v, u) with low's m (v, m, deg): by a plain join, but nodes of over `fan` neighbours by a broadcast that is
    counted to be small, so that their neighbours stay where they are. Fewer edges than `fan` hold no such node."""
    if edges <= fan:
        return rows.join(low.select("v", "m"), "v")
    low = written(low, "cc-low")
    hot = low.where(F.col("deg") > fan).select("v", "m")
    if not hot.limit(1).count():
        return rows.join(low.select("v", "m"), "v")
    calm = rows.join(few(hot.select("v")), "v", "left_anti").join(low.where(F.col("deg") <= fan).select("v", "m"), "v")
    return calm.unionByName(rows.join(few(hot), "v"))


def components(edges: DataFrame, fan: int = 1_000_000) -> DataFrame:
    """edges (a, b: long) -> (node, root): root is the smallest node of the component; nodes without an edge are absent.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Each step is one grouped minimum, combined on
    the map side, and one join on the node; neighbours of a node with over `fan` of them are not brought together. Every
    round is written to the shared folder. Ends when a round changes nothing; the number of rounds grows with the
    logarithm of the longest chain.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "cc")
    mark, n = None, now.count()
    deg = F.count(F.lit(1)).alias("deg")
    while True:
        # large star: every larger neighbour of x links to the smallest of x and its neighbours
        both = now.select("v", "u").unionAll(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"), deg)
        big = _with_low(both.where("u > v"), low, n, fan).select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # small star: x and its smaller neighbours link to the smallest of them
        low = big.groupBy("v").agg(F.min("u").alias("m"), deg)
        small = _with_low(big, low, n, fan).select(F.col("u").alias("v"), F.col("m").alias("u")).unionAll(low.select("v", F.col("m").alias("u")))
        now = written(small.where("v <> u").distinct(), "cc")
        n, h = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
        if mark == (n, h):
            break
        mark = (n, h)
    roots = now.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("node"), "root")
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
