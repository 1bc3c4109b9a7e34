"""Ranks over ranges against ranks by sorting, however rows are dealt and however one key outweighs the rest."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import identity
from tidemark.operators.ranks import ranked


@pytest.mark.parametrize("keys", [[], ["k"], ["k", "j"]])
def test_ranks_equal_sorting(spark, keys):
    rng = random.Random(1)
    rows = [(i, None if i % 11 == 0 else "hot" if rng.random() < 0.6 else f"k{i % 5}", i % 2, None if i % 17 == 0 else rng.randint(0, 40)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, k string, j int, v int").repartition(9)
    got = ranked(df, [F.col("v").desc_nulls_last(), "id"], keys, "r", "n").collect()
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[("id", "k", "j", "v").index(k)] for k in keys), []).append(r)
    want = {}
    for g in groups.values():
        for place, r in enumerate(sorted(g, key=lambda r: (r[3] is None, -(r[3] or 0), r[0])), 1):
            want[r[0]] = (place, len(g))
    assert {r.id: (r.r, r.n) for r in got} == want and len(got) == len(rows)
    assert ranked(df.limit(0), ["id"], keys).count() == 0


def test_new_ids_follow_the_names(spark):
    known = spark.createDataFrame([("b", 7), ("d", 3)], "name string, id int")
    names = spark.createDataFrame([(c,) for c in "zabcdea"], "name string").repartition(5)
    got = {r.name: r.id for r in identity.surrogate_ids(known, names, "name", "id").collect()}
    assert got == {"b": 7, "d": 3, "a": 8, "c": 9, "e": 10, "z": 11}
