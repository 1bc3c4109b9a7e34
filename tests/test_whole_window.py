"""Every supplier's dates have their window and every part name its candidates."""

import random
from collections import defaultdict
from datetime import timedelta

import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.operators import identity

SF = "/root/testdata/sf0.001"


def test_every_supplier_and_date_has_its_window(spark):
    lines = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_suppkey", "date(l_shipdate) AS d", "l_extendedprice AS v").collect():
        lines[r.l_suppkey].append((r.d, r.v))
    want = {}
    for k, own in lines.items():
        for d in {e for e, _ in own}:
            past = [(e, v) for e, v in own if d - timedelta(180) <= e < d]
            if past:
                want[k, d] = (len(past), sum(e >= d - timedelta(30) for e, _ in past), round(max(v for _, v in past), 2))
    got = entry.queries()["trailing_transfer_window"](spark, SF).collect()
    assert {(r.l_suppkey, r.d): (r.n180, r.n30, round(r.biggest, 2)) for r in got} == want and len(got) == len(want)


def test_every_part_name_is_looked_up(spark):
    """All pairs of a block, scored: none at the cutoff is overlooked."""
    parts = {(r.name, r.block) for r in spark.read.parquet(f"{SF}/part.parquet").selectExpr("lower(p_name) AS name", "p_brand AS block").collect()}
    pairs = {(a, b) for a, x in parts for b, y in parts if a != b and x == y}
    scored = next(iter(identity._ratio(iter([pd.DataFrame(sorted(pairs), columns=["name", "candidate"])]))))
    best = defaultdict(list)
    for name, other, score in scored[["name", "candidate", "score"]].itertuples(index=False):
        if score >= 0.78:
            best[name].append((-score, other))
    want = {(a, b) for a, found in best.items() for _, b in sorted(found)[:3]}
    got = {(r.name, r.candidate) for r in entry.queries()["fuzzy_candidates"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("cutoff", [0.6, 0.78, 0.84])
def test_no_close_match_is_lost(spark, cutoff):
    """Short, long, misspelt and swapped names, among them pairs without a common three-letter gram."""
    rng = random.Random(7)
    words = ["inter", "milan", "st", "pauli", "ac", "fc", "b", "real", "sociedad", "o'higgins", "ñublense", "1860", "ab", "abcdef"]
    names = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(60)} | {"", "a", "axbycz", "abc", "abxcdy"}
    for n in sorted(names):
        for _ in range(2):
            x = list(n)
            for _ in range(rng.randint(1, 3)):
                k = rng.randint(0, len(x))
                x[k : k + rng.randint(0, 1)] = rng.choice(["", "x", " ", "e"])
            names.add("".join(x))
    rows = [(n, "u" if i % 3 else "v") for i, n in enumerate(sorted(names))]
    df = spark.createDataFrame(rows, "name string, block string")
    got = {(r.name, r.candidate, r.score) for r in identity.fuzzy_candidates(df, df, cutoff, keep=1000, itself=False).collect()}
    pairs = [(a, b) for a, x in rows for b, y in rows if a != b and x == y]
    scored = next(iter(identity._ratio(iter([pd.DataFrame(pairs, columns=["name", "candidate"])]))))
    want = {tuple(r) for r in scored[scored.score >= cutoff][["name", "candidate", "score"]].itertuples(index=False)}
    assert got == want and len(want) > 100
