"""Span as-of, pair joins, first rows and the encoding cascade against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import joins
from tidemark.sources import readers
from tidemark.streaming import replay

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("seconds", [1, 3600, 10**9])
def test_spans_give_what_one_scan_gives(spark, strict, seconds):
    rng = random.Random(seconds)
    at = lambda: T0 + timedelta(seconds=rng.randint(0, 20_000))
    key = lambda: rng.choice(["hot", "hot", "hot", "b", None])
    left = spark.createDataFrame([(i, key(), None if i == 7 else at()) for i in range(200)], "id int, k string, t timestamp")
    right = spark.createDataFrame([(i, key(), at()) for i in range(120)] + [(900, "b", None)], "rid int, k string, u timestamp")
    one = joins.asof(left, right, ["k"], "t", "u", ["rid"], strict, ["rid"])
    got = joins.asof_spans(left, right, ["k"], "t", "u", ["rid"], seconds, strict, ["rid"])
    assert got.columns == one.columns
    keep = lambda d: sorted((tuple(r) for r in d.where("t IS NOT NULL").collect()), key=str)
    assert keep(got) == keep(one) and got.count() == 200


def test_pairs_match_once_on_both_sides(spark):
    h = lambda n: T0 + timedelta(hours=n)
    left = [(1, "a", "b", h(0)), (2, "b", "a", h(100)), (3, "c", "d", h(0)), (4, "e", "f", h(0)), (5, "f", "e", h(1)), (6, None, "b", h(0)), (7, "g", "h", None)]
    right = [(10, "b", "a", h(1)), (20, "b", "a", h(99)), (30, "c", "d", h(1)), (31, "d", "c", h(-1)), (40, "e", "f", h(2)), (60, None, "b", h(0)), (70, "g", "h", h(0))]
    l, r = spark.createDataFrame(left, "id int, h string, a string, t timestamp"), spark.createDataFrame(right, "other int, h string, a string, u timestamp")  # noqa: E741
    got = sorted((x.id, x.other, x.swapped) for x in joins.pair_tolerance_join(l, r, ("h", "a"), "t", "u", 7200, "id", "other").collect())
    assert got == [(1, 10, True), (2, 20, False)]  # 3 has two partners, 40 has two


def test_first_rows_of_each_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randint(0, 30), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, t int, id int").repartition(6)
    want = {k: sorted((t, i) for kk, t, i in rows if kk == k)[:4] for k in {r[0] for r in rows}}
    got = {}
    for r in readers.first_messages(df, "k", ["t", "id"], 4).collect():
        got.setdefault(r.k, []).append((r.t, r.id))
    assert {k: sorted(v) for k, v in got.items()} == want
    assert readers.first_messages(df.limit(0), "k", ["t"], 4).count() == 0
    once = spark.createDataFrame([("x", k) for k in range(50)], "k string, t int").coalesce(1)
    assert once.mapInArrow(lambda b: b, once.schema).count() == 50


def test_a_stream_gives_the_first_rows_only(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "k long, ts timestamp, v long"
    put = lambda rows: spark.createDataFrame([(k, T0 + timedelta(minutes=m), v) for k, m, v in rows], schema).coalesce(1).write.mode("append").parquet(src)
    put([(1, 5, 10), (1, 1, 11), (2, 3, 20)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = replay.first_n(stream, ["k"], 3).writeStream.outputMode("append").format("memory").queryName("first_n").start()
    q.processAllAvailable()
    put([(1, 9, 12), (1, 7, 13), (2, 0, 21), (3, 0, 30)])
    q.processAllAvailable()
    put([(1, 0, 14), (2, 1, 22), (2, 2, 23)])
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.v) for r in spark.table("first_n").collect()) == [(1, 10), (1, 11), (1, 13), (2, 20), (2, 21), (2, 22), (3, 30)]


def test_encoding_cascade_reads_each_file_in_its_own(spark, tmp_path):
    files = {"a.csv": ("utf-8", "é"), "b.csv": ("utf-8-sig", "ß"), "sub/c.csv": ("cp1252", "€ñ"), "d.csv": ("latin1", "\x81é"), "e.csv": ("utf-8", "plain")}
    (tmp_path / "sub").mkdir()
    for name, (enc, word) in files.items():
        (tmp_path / name).write_bytes(f"name,n\n{word},1\n".encode(enc))
    found = {r.file.rsplit("/", 1)[1]: r.encoding for r in readers.encodings(spark, str(tmp_path)).collect()}
    assert found == {n.rsplit("/")[-1]: e.removesuffix("-sig") for n, (e, _) in files.items()}
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType())])
    assert sorted(r.name for r in readers.csv_cascade(spark, str(tmp_path), schema).collect()) == sorted(w for _, w in files.values())
    (tmp_path / "f.csv").write_text("name,n\nx,notanumber\n")
    with pytest.raises(Exception, match="(?i)malformed|NUMBER|parse"):
        readers.csv_cascade(spark, str(tmp_path), schema).select(F.sum("n")).collect()
