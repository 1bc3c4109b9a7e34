"""A killed run resumes where it stopped, a batch counts once, and readers never see half a version."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from tidemark.sources.resume import Store

SCHEMA = "key long, status string, n long"


def test_versions_replace_rows_by_key(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, ["key"], keep=2)
    put = lambda rows, **kw: store.upsert(spark.createDataFrame(rows, SCHEMA), **kw)
    assert store.rows().count() == 0 and store.last_batch() == -1
    assert put([(1, "done", 1), (2, "failed", 1)], batch=0) and put([(2, "done", 2), (3, "failed", 1), (3, "done", 5)], batch=1, order=[F.desc("n")])
    assert not put([(1, "late", 9)], batch=1) and not put([(1, "late", 9)], batch=0)
    assert sorted(map(tuple, store.rows().collect())) == [(1, "done", 1), (2, "done", 2), (3, "done", 5)]
    put([(4, "failed", 1)])
    assert store.last_batch() == 1 and len(store.versions()) == 2
    work = spark.createDataFrame([(k,) for k in range(1, 7)], "key long")
    assert sorted(r.key for r in store.pending(work).collect()) == [5, 6]
    assert sorted(r.key for r in store.pending(work, F.col("stored.status") == "failed").collect()) == [4, 5, 6]


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, ["key"])
    store.upsert(spark.createDataFrame([(1, "done", 1)], SCHEMA), 0)
    bad = spark.createDataFrame([(1, "x", 0)], SCHEMA).withColumn("n", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.upsert(bad, 1)
    assert [tuple(r) for r in store.rows().collect()] == [(1, "done", 1)] and store.last_batch() == 0
    (tmp_path / "s" / "making-by-one-that-was-killed").mkdir()
    assert [tuple(r) for r in store.rows().collect()] == [(1, "done", 1)]
    assert store.clear_unfinished() >= 1 and store.clear_unfinished() == 0 and len(store.versions()) == 1


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path / "s"), SCHEMA, ["key"]) for _ in range(2))
    row = lambda k: spark.createDataFrame([(k, "done", 1)], SCHEMA)
    seen = b.versions()
    a.upsert(row(1))
    b.versions = lambda real=b.versions, first=[seen]: first.pop() if first else real()
    with pytest.raises(RuntimeError, match="another writer"):
        b.upsert(row(2))
    assert [r.key for r in a.rows().collect()] == [1]


RUN = """
import os, sys
from pyspark.sql import SparkSession, functions as F
sys.path.insert(0, {root!r})
from tidemark.sources.resume import Store

spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
store = Store(spark, {base!r} + "/store", "key long, n long", ["key"])
work = store.batches(lambda b: b.groupBy("key").agg(F.sum("n").alias("n")))

def step(rows, batch):
    with open({base!r} + "/log", "a") as f:
        f.write(f"{{batch}}\\n")
    work(rows, batch)
    if batch == 1 and sys.argv[1] == "kill":
        os._exit(9)  # the batch is in the store, the stream does not know yet

stream = spark.readStream.schema("key long, n long").option("maxFilesPerTrigger", 1).json({base!r} + "/in")
q = stream.writeStream.foreachBatch(step).option("checkpointLocation", {base!r} + "/check").trigger(availableNow=True).start()
q.awaitTermination()
"""


def test_a_stream_killed_between_writing_and_committing_counts_once(spark, tmp_path):
    base = str(tmp_path)
    os.makedirs(f"{base}/in")
    for k in range(4):
        with open(f"{base}/in/{k}.json", "w") as f:
            f.write("".join(f'{{"key": {10 * k + i}, "n": {i + 1}}}\n' for i in range(3)))
        os.utime(f"{base}/in/{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(RUN).format(root=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), base=base))
    run = lambda how: subprocess.run([sys.executable, str(script), how], capture_output=True, text=True, timeout=240)
    assert run("kill").returncode != 0
    store = Store(spark, f"{base}/store", "key long, n long", ["key"])
    assert store.last_batch() == 1 and store.rows().count() == 6
    done = run("go")
    assert done.returncode == 0, done.stderr[-2000:]
    batches = open(f"{base}/log").read().split()
    assert batches == ["0", "1", "1", "2", "3"]  # the second was run again
    assert store.last_batch() == 3 and len(store.versions()) == 3 and store.versions()[-1][0] == 4  # and made no version of its own
    assert {r.key: r.n for r in store.rows().collect()} == {10 * k + i: i + 1 for k in range(4) for i in range(3)}
