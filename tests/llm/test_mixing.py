"""The mix depends on the rows alone, not on how they are split."""

import random
from collections import Counter

import pytest

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string, lang string, row string, uid string"


def rows_of(n):
    rng = random.Random(5)
    rows = [(rng.choice([i, i % 7, None]), " ".join("w" for _ in range(rng.randrange(30))) if rng.random() < 0.95 else None, rng.choice(["a", "a", "b", "c", None]), rng.choice("xy"), "r", "u") for i in range(n)]
    return rows + [(3, "the same row", "a", "x", "r", "u")] * (n // 2)  # a third of all rows are one row


def test_mix_is_the_same_under_every_split(spark):
    rows = rows_of(900)
    took = []
    for parts, order in ((1, rows), (5, rows[::-1]), (13, random.Random(1).sample(rows, len(rows)))):
        df = spark.createDataFrame(order, SCHEMA).repartition(parts)
        took.append((sorted(map(str, mixing.mix(df, fan=8).select("doc_id", "size", "source_size", "target", "copies").collect())), Counter(map(str, mixing.mixed_rows(df, fan=8).collect()))))
    assert took[0] == took[1] == took[2] and len(took[0][0]) == len(rows)


def test_mix_is_the_same_under_another_file_split(spark):
    docs = lambda: spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    runs = []
    for size in ("128m", "100k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            runs.append(sorted(map(str, mixing.mix(docs()).select("doc_id", "size", "copies").collect())))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert runs[0] == runs[1]


def test_rows_are_told_apart(spark):
    df = spark.createDataFrame([(1, "a b c", "s", "x", "r", "u")] * 5 + [(1, "a b c", None, "x", "r", "u"), (None, "a b c", "s", "x", "r", "u")], SCHEMA).repartition(3)
    got = mixing.mix(df)
    assert got.select("uid").distinct().count() == 7 and got.count() == 7
    assert mixing.mixed_rows(df.limit(0)).count() == 0 and mixing.mixed_rows(df).columns == df.columns


@pytest.mark.parametrize("source", [None, "s"])
def test_texts_without_words_are_not_taken(spark, source):
    df = spark.createDataFrame([(i, t, source, "x", "r", "u") for i, t in enumerate([None, "", " \n"])], SCHEMA)
    assert {r.copies for r in mixing.mix(df).collect()} == {0} and mixing.mixed_rows(df).count() == 0
