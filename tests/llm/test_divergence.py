"""The audit against its SQL, against brute force in whole numbers, and odd rows."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.llm import divergence, queries


def brute(rows, least=10, top=10):
    """rows: (text, lang, source)."""
    langs, out = {}, []
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups, docs = langs.setdefault(lang or "", ({}, Counter()))
        groups.setdefault(source or "", Counter()).update(words)
        docs.update(set(words))
    for lang, (groups, docs) in langs.items():
        kept = [t for t in docs if docs[t] >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        whole = share(sum(groups.values(), Counter()))
        p = {s: share(c) for s, c in groups.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-f(p[s][t], whole[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    df = queries.op13_divergence(spark, f"/root/testdata/{sf}")
    assert df.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.ORACLES['op13_divergence']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


@pytest.mark.parametrize("per_chunk,block", [(20_000, 64), (7, 2), (1, 1)])
def test_equals_brute_force_on_odd_rows(spark, monkeypatch, per_chunk, block):
    rng = np.random.default_rng(4)
    words = ["a", "B", "b", "Ça", "ça", "汉字", "z", "éa", "ea", "𝒳", "x-y", "don't", "A1b"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 9))), str(rng.choice(["en", "fr"])), f"s{rng.integers(0, 7)}") for _ in range(160)]
    rows += [(None, None, None), ("", "en", None), ("only one", "xx", "s1"), ("1 2 3", "xx", "s2"), ("q " * 50_000, "en", "s1"), *[("same same", None, "s")] * 12, ("solo", "yy", "s")]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n long, term string")
    real = divergence.pair_distances
    monkeypatch.setattr(divergence, "pair_distances", lambda g, e: real(g, e, block))
    got = divergence.audit(docs.repartition(5), per_chunk=per_chunk)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_counts_flushed_early_add_up(spark):
    rows = [(f"w{i % 50} x{i % 7} x", "en", f"s{i % 3}", i) for i in range(500)]
    docs = spark.createDataFrame([(t.replace("0", "q").replace("1", "r"), *r) for t, *r in rows], "text string, lang string, source string, i int")
    assert sorted(map(tuple, divergence.term_counts(docs, 5).collect())) == sorted(map(tuple, divergence.term_counts(docs).collect()))


def test_shares_are_exact():
    rng = np.random.default_rng(0)
    for total in (3, 1000, 7 * 10**12 + 1, 8 * 10**15):
        count = np.append(rng.integers(0, total, 200, endpoint=True), [0, total])
        assert divergence.shares(count, total).tolist() == [1 + 10**9 * int(c) // total for c in count]
