"""The memory is every other row."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tidemark.operators import models

SF = "/root/testdata/sf0.001"


def test_memory_is_every_other_row(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    ids, x, y = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float), np.array([r.label for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    want = {int(i): y[np.argsort(-row, kind="stable")[:5]].mean() for i, row in zip(ids, s)}
    got = {r.vec_id: r.memory_value for r in entry.queries()["knn_memory"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=2e-6)
    e = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS id", "cast(embedding AS array<double>) AS v", "cast(label AS double) AS value")
    every = {r.id: r.memory_value for r in models.memory_values(e, e, 5).collect()}
    assert every == pytest.approx(want, abs=2e-6)


def test_blocks_of_both_sides_give_the_same(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS id", "cast(embedding AS array<double>) AS v", "cast(label AS double) AS value")
    whole, blocks = ({r.id: r.memory_value for r in models.memory_values(e, e, 5, block=b).collect()} for b in (4096, 60))
    assert whole == pytest.approx(blocks, abs=1e-12) and len(whole) == e.count()


def test_query_and_its_sql_answer_every_row(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = dict(db.execute(entry.oracle_sql()["knn_memory"]).fetchall())
    assert set(want) == {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    assert {r.vec_id: r.memory_value for r in entry.queries()["knn_memory"](spark, SF).collect()} == want


def test_shares_of_the_memory_give_the_same(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v", "cast(vec_id AS double) AS value")
    whole, shares = ({r.id: r.memory_value for r in models.memory_values(e, e, 5, block=b).collect()} for b in (500, 300))
    assert whole == pytest.approx(shares, abs=1e-9) and len(whole) == e.count()


def test_copies_near_copies_and_ties(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([np.repeat(base[:1], 300, axis=0), base[1] + 1e-7 * rng.normal(size=(300, 8)), base[2:], np.zeros((3, 8))])
    ids = rng.permutation(len(x)) - 50
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = np.round(unit @ unit.T, 9)
    np.fill_diagonal(s, -np.inf)
    want = {int(i): np.sqrt(ids[np.lexsort((ids, -row))[:5]] + 51).mean() for i, row in zip(ids, s)}
    e = spark.createDataFrame([(int(i), v.tolist(), float(np.sqrt(i + 51))) for i, v in zip(ids, x)], "id long, v array<double>, value double")
    for block in (16384, 100):
        got = {r.id: r.memory_value for r in models.memory_values(e, e, 5, block=block).collect()}
        assert got == pytest.approx(want, abs=1e-12)


def test_values_and_vectors_may_be_null(spark):
    m = spark.createDataFrame([(1, [1.0, 0.0], 3.0), (2, [1.0, 0.1], None), (3, [0.0, 1.0], 9.0), (4, None, 5.0), (5, [float("nan"), 1.0], 7.0)], "id long, v array<double>, value double")
    got = {r.id: r.memory_value for r in models.memory_values(m, m, 2).collect()}
    assert got == {1: 9.0, 2: 6.0, 3: 3.0, 4: None, 5: None}
