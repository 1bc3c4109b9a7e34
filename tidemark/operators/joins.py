"""Joins in time and joins that check themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A side of a validated join has a key more than once."""


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, payload: list[str], strict: bool = True, tie: list[str] | None = None) -> DataFrame:
    """Left rows with the payload of the latest right row of the key, before (strict) or up to the left time.

    Both sides are stacked, sorted once by key and time, and the last right row is carried forward: one shuffle and a
    linear scan, where a join on an inequality would compare all pairs of a key. Adds matched_ts; NULL without a match.
    Equal right times: the largest by `tie`. Right rows without a time match nothing.
    """
    right = right.where(F.col(right_ts).isNotNull())
    extra = [c for c in left.columns if c not in keys]
    pack = F.struct(F.col(right_ts).alias("matched_ts"), *[F.col(p) for p in payload])
    r = right.select(*keys, F.col(right_ts).alias("__t"), F.lit(1).alias("__s"), F.lit(None).cast(left.select(F.struct(*extra)).schema[0].dataType).alias("__l"), pack.alias("__r"), (F.struct(*tie) if tie else F.lit(0)).alias("__o"))
    l = left.select(*keys, F.col(left_ts).alias("__t"), F.lit(0 if strict else 2).alias("__s"), F.struct(*extra).alias("__l"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.lit(None).cast(r.schema["__o"].dataType).alias("__o"))  # noqa: E741
    w = Window.partitionBy(*keys).orderBy("__t", "__s", F.col("__o").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l).withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where(F.col("__s") != 1)
    return both.select(*keys, *[F.col(f"__l.{c}").alias(c) for c in extra], "__m.*")


def asof_spans(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, payload: list[str], seconds: int, strict: bool = True, tie: list[str] | None = None) -> DataFrame:
    """asof() where a key may hold a large share of all rows: the same rows, a key being as many tasks as it has spans.

    Time is cut into spans of `seconds`. Within a span the last right row is carried forward as in asof(); the last right
    row of each span (one row a key and span) is carried into the later ones, and answers where a span has none yet.
    """
    span = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1_000_000 * seconds)).alias("__span")
    l, r = left.withColumn("__span", span(left_ts)), right.withColumn("__span", span(right_ts))  # noqa: E741
    near = asof(l, r, [*keys, "__span"], left_ts, right_ts, payload, strict, tie)
    found = F.struct(F.col(right_ts).alias("matched_ts"), *[F.col(p) for p in payload])
    last = r.where(F.col(right_ts).isNotNull()).groupBy(*keys, "__span").agg(F.max_by(found, F.struct(right_ts, *(tie or []))).alias("__last"))
    # spans with left rows and spans with right rows, in order: few rows a key, whatever its share
    marks = l.select(*keys, "__span").distinct().withColumn("__last", F.lit(None).cast(last.schema["__last"].dataType)).unionByName(last).groupBy(*keys, "__span").agg(F.max("__last").alias("__last"))
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    carried = marks.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__span").alias("__s"), before.alias("__before")).where("__before IS NOT NULL")
    same = F.col("__span") == F.col("__s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = near.join(carried, same, "left")
    own = F.col("matched_ts").isNotNull()
    rest = [c for c in left.columns if c not in keys]
    return out.select(*keys, *rest, *[F.when(own, F.col(c)).otherwise(F.col(f"__before.{c}")).alias(c) for c in ("matched_ts", *payload)])


def validated_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """An equi-join that raises CardinalityError if a side that must be unique on `on` is not (one action per such side)."""
    for side, name in ((left, "left"), (right, "right")):
        if validate == "one_to_one" or name == "right" and validate == "many_to_one" or name == "left" and validate == "one_to_many":
            if side.groupBy(*on).count().where("count > 1").limit(1).count():
                raise CardinalityError(f"{name} side is not unique on {on}")
    return left.join(right, on, how)


def interval_join(left: DataFrame, intervals: DataFrame, keys: list[str], ts: str, start: str, end: str, order: list[Column], days: int = 30) -> DataFrame:
    """Left rows with the best interval [start, end) that holds their time; open ends are NULL; `order` ranks candidates.

    Intervals may overlap. Closed ones stand in every bucket of `days` days that they touch, so that the join is an equality
    and a row meets only intervals near its time. Open ones have no end to be dealt by: of these a row meets its key's.
    """
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    bucket = lambda c: F.floor(second(c) / (86_400 * days))
    left = left.withColumn("__row", F.monotonically_increasing_id())
    hit = (F.col(start).isNull() | (F.col(start) <= F.col(ts))) & (F.col(end).isNull() | (F.col(ts) < F.col(end)))
    closed = F.col(start).isNotNull() & F.col(end).isNotNull()
    near = left.withColumn("__b", bucket(ts)).join(intervals.where(closed & (F.col(start) < F.col(end))).withColumn("__b", F.explode(F.sequence(bucket(start), bucket(end)))), [*keys, "__b"]).drop("__b")
    both = near.unionByName(left.join(intervals.where(~closed), keys)).where(hit)
    best = both.withColumn("__rank", F.row_number().over(Window.partitionBy("__row").orderBy(*order))).where("__rank = 1")
    rest = [c for c in intervals.columns if c not in keys]
    return left.join(best.select("__row", *rest), "__row", "left").drop("__row")


def current_interval(left: DataFrame, intervals: DataFrame, keys: list[str], ts: str, start: str, end: str) -> DataFrame:
    """Left rows with the interval [start, end) that holds their time, where a key's intervals do not overlap.

    The last start up to the time is carried forward (asof), and dropped where its interval has ended: one sorted pass.
    """
    rest = [c for c in intervals.columns if c not in keys]
    out = asof(left, intervals.where(F.col(start).isNotNull()), keys, ts, start, rest, strict=False)
    over = F.col(end).isNotNull() & (F.col(end) <= F.col(ts))
    return out.select(*left.columns, *[F.when(~over, F.col(c)).alias(c) for c in rest])


def change_intervals(changes: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Adds valid_to, the key's next start."""
    return changes.withColumn("valid_to", F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def _within(left: DataFrame, right: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """keys, __t and, within +-seconds of it, __lefts and __rights, how many rows, and __rt, the last right time; both sides have keys and __t.

    No pair is formed: rows of a time are counted first, then numbers are differences of two running sums. A time stands in
    the spans of `seconds` before and after its own, so a key is as many sorted runs as it has spans.
    """
    one = lambda df, n: df.select(*keys, "__t", F.lit(n).alias("l"), F.lit(1 - n).alias("r")).dropna(subset=[*keys, "__t"])
    times = one(left, 1).unionByName(one(right, 0)).groupBy(*keys, "__t").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    us = max(1, int(seconds * 1_000_000))
    span = F.expr(f"(__t - pmod(__t, {us})) div {us}")
    dealt = times.withColumn("__d", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("__span", span + F.col("__d"))
    w = Window.partitionBy(*keys, "__span").orderBy("__t")
    upto, before = w.rangeBetween(Window.unboundedPreceding, int(seconds * 1_000_000)), w.rangeBetween(Window.unboundedPreceding, -int(seconds * 1_000_000) - 1)
    near = lambda n: F.sum(n).over(upto) - F.coalesce(F.sum(n).over(before), F.lit(0))
    out = dealt.select(*keys, "__t", "__d", near("l").alias("__lefts"), near("r").alias("__rights"), F.max(F.when(F.col("r") > 0, F.col("__t"))).over(upto).alias("__rt"))
    return out.where("__d = 0").drop("__d")


def _alone(df: DataFrame, times: DataFrame, keys: list[str], near: str, row_id: str) -> DataFrame:
    """Rows whose id has one partner in all."""
    met = df.join(times.where(F.col(near) > 0), [*keys, "__t"])
    return met.withColumn("__n", F.sum(near).over(Window.partitionBy(row_id))).where("__n = 1").drop("__n", near)


def tolerance_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, seconds: int, left_id: str) -> DataFrame:
    """Left rows joined to the only right row of the key within +-seconds; rows with several candidates are rejected.

    Candidates are counted, not listed: only a row that has one is joined to it, by key and time.
    """
    l, r = left.withColumn("__t", _micros(left_ts)), right.withColumn("__t", _micros(right_ts))  # noqa: E741
    times = _within(l, r, [key], seconds).select(key, "__t", "__rights", "__rt")
    return _alone(l, times, [key], "__rights", left_id).drop("__t").join(r.withColumnRenamed("__t", "__rt"), [key, "__rt"]).drop("__rt")


def pair_tolerance_join(left: DataFrame, right: DataFrame, pair: tuple[str, str], left_ts: str, right_ts: str, seconds: int, left_id: str, right_id: str) -> DataFrame:
    """Left and right rows of the same two parties, in either order, within +-seconds, where each is the other's only match.

    A row with several partners is in conflict and leaves, and so do its partners' pairs with it. Adds swapped: whether the
    right side has the parties the other way round. Rows with a missing party or time match nothing. Partners are counted,
    not listed, as in tolerance_join.
    """
    sides = F.array_sort(F.array(*[F.col(c).cast("string") for c in pair]))
    key = F.when(F.col(pair[0]).isNotNull() & F.col(pair[1]).isNotNull(), sides)
    l = left.withColumn("__pair", key).withColumn("__t", _micros(left_ts))  # noqa: E741
    r = right.select(F.col(right_id), F.col(right_ts), key.alias("__pair"), F.col(pair[0]).alias("__first"), *[c for c in right.columns if c not in (right_id, right_ts, *pair)]).withColumn("__t", _micros(right_ts))
    times = _within(l, r, ["__pair"], seconds)
    lone = _alone(l, times.select("__pair", "__t", "__rights", "__rt"), ["__pair"], "__rights", left_id).drop("__t")
    other = _alone(r, times.select("__pair", "__t", "__lefts"), ["__pair"], "__lefts", right_id).withColumnRenamed("__t", "__rt")
    both = lone.join(other, ["__pair", "__rt"])
    return both.withColumn("swapped", F.col("__first") != F.col(pair[0])).drop("__pair", "__rt", "__first")


def trailing_join(left: DataFrame, events: DataFrame, key: str, date: str, event_date: str, days: int) -> DataFrame:
    """Pairs of left rows and events of the key in [date - days, date): equality on buckets of `days` days, then the test."""
    b = lambda c: F.floor(F.unix_date(F.col(c)) / days)
    l = left.withColumn("__b", F.explode(F.array(b(date) - 1, b(date))))  # noqa: E741
    r = events.withColumn("__b", b(event_date))
    return l.join(r, [key, "__b"]).where((F.col(event_date) < F.col(date)) & (F.col(event_date) >= F.date_sub(F.col(date), days))).drop("__b")


def latest_set(left: DataFrame, snapshots: DataFrame, keys: list[str], ts: str, snapshot: str) -> DataFrame:
    """Left rows with every row of the key's latest snapshot strictly before their time, NULLs without one.

    The as-of join runs over distinct snapshot dates; the rows of a set are joined by equality after it.
    """
    dates = snapshots.select(*keys, snapshot).distinct()
    dated = asof(left, dates, keys, ts, snapshot, []).withColumnRenamed("matched_ts", snapshot)
    return dated.join(snapshots, [*keys, snapshot], "left")


def evidence(matches: DataFrame, games: DataFrame, place: list[str], mapping: DataFrame) -> DataFrame:
    """(place, team, id, n): matches in which both teams' candidate ids play each other in games on that date.

    matches: place, home, away; games: place, home_id, away_id in either order; mapping: team, id, one row per team.
    """
    ids = lambda t: mapping.select(F.col("team").alias(t), F.col("id").alias(f"{t}_cand"))
    pairs = matches.join(ids("home"), "home").join(ids("away"), "away")
    own = F.array_sort(F.array("home_cand", "away_cand"))
    played = games.select(*place, F.array_sort(F.array("home_id", "away_id")).alias("__p")).distinct()
    met = pairs.withColumn("__p", own).join(played, [*place, "__p"], "left_semi")
    both = met.select(F.inline(F.array(*[F.struct(F.col(t).alias("team"), F.col(f"{t}_cand").alias("id")) for t in ("home", "away")])))
    return both.groupBy("team", "id").agg(F.count(F.lit(1)).alias("n"))


def dual_role(facts: DataFrame, dim: DataFrame, key: str, roles: dict[str, str]) -> DataFrame:
    """Join a dimension once per role: roles maps a prefix to the fact column."""
    for prefix, column in roles.items():
        own = dim.select(F.col(key).alias(f"__{prefix}"), *[F.col(c).alias(f"{prefix}_{c}") for c in dim.columns if c != key])
        facts = facts.join(own, facts[column] == own[f"__{prefix}"], "left").drop(f"__{prefix}")
    return facts


def replay_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Full outer comparison: keys, both values and side: left_only, right_only, both_equal or both_differ."""
    x, y = (df.select(*keys, F.col(value).alias(n), F.lit(True).alias(f"__{n}")) for df, n in ((a, "left_value"), (b, "right_value")))
    same = F.coalesce(F.abs(F.col("left_value") - F.col("right_value")) <= tolerance, F.col("left_value").isNull() & F.col("right_value").isNull())
    side = F.when(F.col("__right_value").isNull(), "left_only").when(F.col("__left_value").isNull(), "right_only").when(same, "both_equal").otherwise("both_differ")
    return x.join(y, keys, "full").select(*keys, "left_value", "right_value", side.alias("side"))
