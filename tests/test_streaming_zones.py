"""The cutoffs of a stream are instants: the same whatever the session's time zone, each once."""

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import replay

MINUTE = 60_000_000
START = 1_710_072_000_000_000  # 2024-03-10 12:00 UTC, the day New York's clocks change


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_cutoffs_do_not_depend_on_the_zone(spark, tmp_path, zone):
    schema = "market long, runner string, ts timestamp, price double, in_play boolean, market_start timestamp"
    first = [(1, "h", -120, 2.0), (1, "h", -60, 2.2), (1, "a", -30, 3.0), (1, "h", -5, 9.0), (2, "x", -600, 4.0)]
    later, last = [(3, "z", 60, 5.0)], [(4, "z", 120, 5.0)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        src, name = str(tmp_path / "in"), f"cutoffs_{zone.replace('/', '_')}"

        def put(rows):
            made = spark.createDataFrame([(m, r, START + t * MINUTE, p, START) for m, r, t, p in rows], "market long, runner string, t long, price double, s long")
            made.select("market", "runner", F.timestamp_micros("t").alias("ts"), "price", F.lit(False).alias("in_play"), F.timestamp_micros("s").alias("market_start")).coalesce(1).write.mode("append").parquet(src)

        put(first)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = replay.cutoff_prices(stream, ["1 hour", "10 minutes"]).writeStream.outputMode("append").format("memory").queryName(name).start()
        for rows in (later, last):
            q.processAllAvailable()
            put(rows)
        q.processAllAvailable()
        q.stop()
        got = sorted((r.market, (r.c - START) // MINUTE, r.runner, r.price, r.age_s) for r in spark.table(name).select("*", F.unix_micros("cutoff").alias("c")).collect())
        assert got == [(1, -60, "h", 2.2, 0.0), (1, -10, "a", 3.0, 1200.0), (1, -10, "h", 2.2, 3000.0), (2, -60, "x", 4.0, 32400.0), (2, -10, "x", 4.0, 35400.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
