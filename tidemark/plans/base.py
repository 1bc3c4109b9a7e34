"""Registry of queries and the fixture view they run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Two-sided fixtures from orders, in SQL that Spark and DuckDB read alike.
FX_SQL = """SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date, o_orderpriority AS league,
  CAST(year(o_orderdate) AS INT) AS season,
  CAST(o_custkey % 20 AS INT) AS home, CAST((o_custkey*7 + o_orderkey*3 + 1) % 20 AS INT) AS away,
  CAST(o_orderkey % 5 AS INT) AS hg, CAST((o_orderkey*7 + o_custkey) % 4 AS INT) AS ag,
  CAST(120 + (o_orderkey*37) % 400 AS DOUBLE)/100 AS odds_h, CAST(250 + (o_orderkey*53) % 300 AS DOUBLE)/100 AS odds_d,
  CAST(130 + (o_orderkey*71) % 500 AS DOUBLE)/100 AS odds_a, CAST((o_orderkey*13) % 17 - 8 AS DOUBLE)/4 AS ah_line
FROM {orders} WHERE o_custkey % 20 <> (o_custkey*7 + o_orderkey*3 + 1) % 20"""

FX = f"fx AS ({FX_SQL.format(orders='orders')})"

#: Team perspective: two rows per fixture.
SIDES = f"""{FX}, sides AS (
  SELECT match_id, match_date, league, season, home AS team, away AS opp, TRUE AS is_home, hg AS gf, ag AS ga FROM fx
  UNION ALL SELECT match_id, match_date, league, season, away, home, FALSE, ag, hg FROM fx)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    select, where = FX_SQL.format(orders="o").split("FROM o WHERE")
    cols = select.removeprefix("SELECT ")
    return orders.where(where).select(*[F.expr(c.strip()) for c in _split(cols)])


def _split(cols: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in cols:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


def sides(fx: DataFrame) -> DataFrame:
    """Two rows per fixture, one pass: team, opp, is_home, gf, ga."""
    side = lambda a, b, f, g, h: F.struct(F.col(a).alias("team"), F.col(b).alias("opp"), F.lit(h).alias("is_home"), F.col(f).alias("gf"), F.col(g).alias("ga"))
    return fx.select("match_id", "match_date", "league", "season", F.inline(F.array(side("home", "away", "hg", "ag", True), side("away", "home", "ag", "hg", False))))


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add
