"""Empty tables, repeated rows, nulls in every column and clashing names, for the learnt operators and every pipeline stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import packing, quality, queries, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, uid string, k long, __t string"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    w = [f"word{i}" for i in range(400)]
    good = [" ".join(rng.choice(w) for _ in range(120)) for _ in range(12)]
    rows = [(i, t, "en", "a", len(t), 0.0, "u", 1, "t") for i, t in enumerate(good)]
    rows += [rows[0], rows[0], (None, good[1], None, None, None, None, None, None, None), (50, None, None, None, None, None, None, None, None), (51, "", "en", "b", 0, 0.0, "u", 1, "t"), (52, " \n ", None, "b", 3, 0.0, "u", 1, "t"), (53, "long " * 60_000, "en", "b", 300_000, 0.0, "u", 1, "t")]
    return spark.createDataFrame(rows, SCHEMA)


def test_classifiers_take_odd_rows_one_for_one(spark, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net, machine = quality.fit(docs, labels), toxicity.fit(docs, labels)
    for scored in (quality.score(odd, net), toxicity.score(odd, machine)):
        rows = scored.collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        same = {r.score for r in rows if r.doc_id == 0}
        assert len(same) == 1  # repeated rows have one score
        blank = {r.score for r in rows if r.doc_id in (50, 51, 52)}
        assert len(blank) == 1
    empty = odd.limit(0)
    assert quality.score(empty, net).count() == toxicity.score(empty, machine).count() == quality.keep_good(empty, net).count() == 0
    assert quality.fit(empty, labels) is None and toxicity.fit(empty, labels).bias == -1.0


@pytest.mark.parametrize("stage", range(4))
def test_stages_give_the_columns_of_documents(spark, odd, stage):
    out = corpus_pipeline.STAGES[stage][1](spark, odd, SF)
    assert out.columns == list(corpus_pipeline.COLUMNS)
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    if stage == 1:  # one row of the three equal ones and of the two with one text; one of the three without words
        assert sorted(i for i in ids if i is not None) == [*range(12), 50, 53] and None not in ids
    if stage == 2:  # repeats go wholly, and what is left of nothing goes too
        assert not {0, 50, 51, 52} & set(ids) and set(range(2, 12)) <= set(ids)
    if stage == 3:  # rows without words have no copies
        assert not {50, 51, 52} & set(ids) and all(ids.count(i) <= 2 for i in range(1, 12))
    assert corpus_pipeline.STAGES[stage][1](spark, odd.limit(0), SF).count() == 0


def test_packing_keeps_null_ids_and_repeats(spark, odd):
    got = packing.pack_documents(odd, queries.tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    n = {r.doc_id: r.n for r in got}
    assert n[50] == n[51] == n[52] == 1 and n[0] == 3 * next(r.d for r in got if r.doc_id == 0) and n[None] == n[1]
    assert corpus_pipeline.pack(spark, odd.limit(0), SF).count() == 0


def test_packing_across_blocks_of_production_size(spark):
    """More tokens than a block holds, in one task: no id is lost or doubled where blocks meet."""
    text = "alpha beta gamma delta " * 6_000
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.col("id").cast("string")).alias("text")).coalesce(1)
    pieces = packing.pack_documents(docs, queries.tokenizer_path())
    assert pieces.agg(F.sum("length")).first()[0] > 2_000_000
    by = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d"), F.min("start").alias("s"), F.max(F.col("start") + F.col("length")).alias("e")).collect()
    assert len(by) == 100 and all(r.n == r.d == r.e and r.s == 0 for r in by)
    short = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n < 4096").collect()
    assert all(r.n & (r.n - 1) == 0 for r in short)
