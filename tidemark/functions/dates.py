"""Date parsing and season arithmetic. What cannot be parsed is NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted shapes and their formats, in order.
SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yy"),
)


def try_date(x: Column, fmt: str) -> Column:
    return F.try_to_timestamp(x, F.lit(fmt)).cast("date")


def parse_mixed_date(x: Column) -> Column:
    t = F.trim(x)
    return F.coalesce(*[F.when(t.rlike(shape), try_date(t, fmt)) for shape, fmt in SHAPES])


def at_time(date: Column, time: Column) -> Column:
    """Date and HH:MM[:SS]; a blank or missing time is midnight."""
    t = F.when(F.trim(time).rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), F.trim(time)).otherwise("00:00")
    t = F.when(t.rlike(r"^\d{1,2}:\d{2}$"), F.concat(t, F.lit(":00"))).otherwise(t)
    return F.try_to_timestamp(F.concat_ws(" ", date.cast("string"), t), F.lit("yyyy-MM-dd H:mm:ss"))


def season_start(date: Column, first_month: int = 7) -> Column:
    """Year in which the date's season began."""
    return F.year(date) - (F.month(date) < first_month).cast("int")


def season_label(date: Column) -> Column:
    s = season_start(date)
    return F.concat_ws("/", s.cast("string"), F.lpad(F.pmod(s + 1, F.lit(100)).cast("string"), 2, "0"))


def weekday_eligible(date: Column) -> Column:
    """Saturday, Sunday, Wednesday and Thursday; false for a missing date."""
    return F.coalesce(F.weekday(date).isin(5, 6, 2, 3), F.lit(False))


def season_from_path(path: Column, pivot: int = 50) -> Column:
    """Start year from 2023-24, 2324 or 2023_2024 in a file name."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    four = F.regexp_extract(name, r"((?:19|20)\d{2})[-_/](?:(?:19|20)?\d{2})", 1)
    two = F.regexp_extract(name, r"(?<!\d)(\d{2})(\d{2})(?!\d)", 1)
    y = two.try_cast("int")
    return F.when(four != "", four.try_cast("int")).when(two != "", F.when(y < pivot, 2000 + y).otherwise(1900 + y))


def path_date(path: Column) -> Column:
    """A date from .../2025/January/2/..."""
    return try_date(F.concat_ws("-", *[F.regexp_extract(path, r"(\d{4})/([A-Z][a-z]+)/(\d{1,2})(?:/|$)", k) for k in (1, 2, 3)]), "yyyy-MMMM-d")


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
