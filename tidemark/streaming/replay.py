"""Structured Streaming variants: windows, sessions, deduplication and last-price state with timers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, late: str | None) -> DataFrame:
    """events with a watermark; None where an earlier step has set it."""
    return events.withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    return _marked(events, late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str | None = "10 minutes") -> DataFrame:
    return _marked(events, late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    return _marked(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def last_price(events: DataFrame) -> DataFrame:
    """market, runner, price, updates as state that survives batches: prices of 1 or less and in-play updates are ignored.

    events: market, runner, ts, price, in_play. One output row per market and runner and batch with a change.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        price, ts, n, playing = state.get if state.exists else (None, None, 0, False)
        for f in frames:
            for r in f.sort_values("ts", kind="stable").itertuples():
                if r.in_play is not None and not pd.isna(r.in_play):
                    playing = bool(r.in_play)
                t = int(r.ts_us)
                if not playing and r.price > 1 and (ts is None or t >= ts):
                    price, ts, n = float(r.price), t, n + 1
        state.update((price, ts, n, playing))
        if price is not None:
            yield pd.DataFrame({"market": [key[0]], "runner": [key[1]], "price": [price], "updates": [n]})

    return events.withColumn("ts_us", F.unix_micros("ts")).groupBy("market", "runner").applyInPandasWithState(step, "market long, runner string, price double, updates long", "price double, ts long, n long, playing boolean", "update", "NoTimeout")


def cutoff_prices(events: DataFrame, cutoffs: list[str], late: str = "10 minutes") -> DataFrame:
    """market, cutoff, runner, price, age_s: last prices above 1 as of each cutoff, emitted by event-time timers.

    events: market, runner, ts (timestamp), price, in_play, market_start (timestamp). cutoffs: intervals before the start,
    such as '1 hour'. Messages are held until the watermark has passed them, then replayed in order of time. A cutoff is
    emitted once the watermark is past it, by a message or by the market's timer, so that an update at exactly the
    cutoff still counts and a market that falls silent is flushed all the same. Updates of 1 or less, from the start on, or
    while the market is in play change nothing.
    """
    deltas = sorted((pd.Timedelta(c).value // 1000 for c in cutoffs), reverse=True)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, prices, playing, start, done = json.loads(state.get[0]) if state.exists else ([], {}, False, None, 0)
        for f in frames:
            for r in f.itertuples():
                start = start if start is not None else int(r.start_us)
                held.append([int(r.ts_us), r.runner, float(r.price), None if r.in_play is None or pd.isna(r.in_play) else bool(r.in_play)])
        mark = state.getCurrentWatermarkMs() * 1000
        held.sort(key=lambda m: m[0])
        out, pending = [], [start - d for d in deltas][done:]

        def emit(at: int) -> None:
            nonlocal done
            done += 1
            out.extend((key[0], at, runner, p, (at - t) / 1e6) for runner, (p, t) in sorted(prices.items()))

        while held and held[0][0] < mark:
            t, runner, price, flag = held.pop(0)
            while pending and pending[0] < t:
                emit(pending.pop(0))
            playing = playing if flag is None else flag
            if not playing and t < start and price > 1:
                prices[runner] = (price, t)
        while pending and pending[0] < mark:
            emit(pending.pop(0))
        if pending or held:
            state.update((json.dumps([held, prices, playing, start, done]),))
            wake = [*pending[:1], *(m[0] for m in held[:1])]
            state.setTimeoutTimestamp(max(min(wake) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["market", "cutoff_us", "runner", "price", "age_s"])

    # instants go in and come out as microseconds, which no session time zone moves
    marked = events.withWatermark("ts", late).select("market", "runner", "ts", "price", "in_play", F.unix_micros("ts").alias("ts_us"), F.unix_micros("market_start").alias("start_us"))
    out = marked.groupBy("market").applyInPandasWithState(step, "market long, cutoff_us long, runner string, price double, age_s double", "held string", "append", "EventTimeTimeout")
    return out.select("market", F.timestamp_micros("cutoff_us").alias("cutoff"), "runner", "price", "age_s")


def first_n(events: DataFrame, keys: list[str], n: int = 100) -> DataFrame:
    """The first n rows of each key as they arrive (within a batch by ts): state is one counter a key, and a key that has
    had its n rows is passed over without being looked at again."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        left = state.get[0] if state.exists else n
        if left:
            best = None
            for f in frames:
                both = f if best is None else pd.concat([best, f])
                best = both.sort_values("ts", kind="stable").head(left)
            state.update((left - len(best),))
            yield best

    return events.groupBy(*keys).applyInPandasWithState(step, kinds, "rows_left long", "append", "NoTimeout")
