"""Column contracts: roles of odds columns, feature groups and guards, resolved from names before any row is read."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bookmaker prefixes and suffixes of odds column names.
BOOKS = ("B365", "BW", "IW", "PS", "P", "WH", "VC", "Max", "Avg", "BbMx", "BbAv")
_ODDS = re.compile(rf"^(?P<book>{'|'.join(BOOKS)})(?P<close>C?)(?P<sel>H|D|A|>2\.5|<2\.5|AHH|AHA)$")


@dataclass(frozen=True)
class Role:
    column: str
    market: str
    selection: str
    bookmaker: str | None
    timing: str  # snapshot, closing, result, identity, unknown


def classify(column: str) -> Role:
    m = _ODDS.match(column)
    if m:
        sel = m["sel"]
        kind = "1x2" if sel in ("H", "D", "A") else "asian_handicap" if sel.startswith("AH") else "over_under_25"
        return Role(column, kind, sel, m["book"], "closing" if m["close"] else "snapshot")
    if column in ("AHh", "AHCh"):
        return Role(column, "asian_handicap", "line", None, "closing" if column == "AHCh" else "snapshot")
    if re.fullmatch(r"FT(HG|AG|R)|HT(HG|AG|R)|[HA](S|ST|C|F|Y|R)", column):
        return Role(column, "result", column, None, "result")
    if column in ("Div", "Date", "Time", "HomeTeam", "AwayTeam", "Referee"):
        return Role(column, "identity", column, None, "identity")
    return Role(column, "unknown", column, None, "unknown")


def is_closing(column: str) -> bool:
    return classify(column).timing == "closing" or bool(re.search(r"(^|_)clos(e|ing)(_|$)", column, re.I))


def assert_no_closing(columns: list[str]) -> None:
    found = [c for c in columns if is_closing(c)]
    if found:
        raise ValueError(f"closing columns among features: {found}")


def feature_group(columns: list[str], patterns: list[str], forbidden: list[str] = ()) -> list[str]:
    """Columns that match a pattern and no forbidden one, in order."""
    return [c for c in columns if any(re.search(p, c) for p in patterns) and not any(re.search(p, c) for p in forbidden)]


def odds_pairs(columns: list[str]) -> dict[str, str]:
    """Snapshot column -> its closing counterpart, where both exist."""
    have = set(columns)
    return {c: k for c in columns if (m := _ODDS.match(c)) and not m["close"] and (k := f"{m['book']}C{m['sel']}") in have}


def usable(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, usable: whether a column has more than one value; nulls are none. One aggregation."""
    spread = [F.struct(F.lit(c).alias("feature"), F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias("usable")) for c in columns]
    return df.agg(F.array(*spread).alias("f")).select(F.inline("f"))


def odds_inventory(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, column: rows, values, valid odds (above 1) and invalid ones, coverage and range of each column; one pass."""
    n = F.count(F.lit(1)).alias("match_rows")
    stats = []
    for c in columns:
        v = F.col(c)
        stats.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("non_null_values"), F.count_if(v > 1).alias("valid_odds_values"), F.count_if(v <= 1).alias("invalid_odds_le_1"), F.min(v).alias("min_value"), F.max(v).alias("max_value")))
    one = df.groupBy(*keys).agg(n, F.array(*stats).alias("__s")).select(*keys, "match_rows", F.inline("__s"))
    return one.withColumn("valid_odds_coverage", F.col("valid_odds_values") / F.col("match_rows"))
