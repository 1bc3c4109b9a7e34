"""Bin completion against exhaustive search, ids against the tokenizer, and the packing against its contract."""

import functools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bestfit, queries

SF = "/root/testdata/sf0.01"
PATH = queries.tokenizer_path("byte_bpe_50k.json")


def fewest(items, capacity):
    """Exhaustive: the fewest bins for a multiset of items."""

    @functools.cache
    def best(rest):
        if not rest:
            return 0
        found = len(rest)
        first, others = rest[0], rest[1:]
        for mask in range(1 << len(others)):
            own = [x for i, x in enumerate(others) if mask >> i & 1]
            if first + sum(own) <= capacity:
                found = min(found, 1 + best(tuple(x for i, x in enumerate(others) if not mask >> i & 1)))
        return found

    return best(tuple(sorted(items, reverse=True)))


def check(made, counts, capacity):
    seen = np.zeros_like(counts)
    for filling, n in made:
        assert n > 0 and sum(filling) <= capacity
        np.add.at(seen, list(filling), n)
    assert (seen == counts).all()


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_the_fewest_possible(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    items = [rng.randint(1, capacity if seed % 2 else capacity // 2 + 2) for _ in range(rng.randint(1, 9))]
    counts = np.bincount(items, minlength=capacity + 1)
    made = bestfit.plan(counts, capacity)
    check(made.fillings, counts, capacity)
    check(bestfit.best_fit(counts, capacity), counts, capacity)
    assert made.bins == sum(n for _, n in made.fillings) == fewest(items, capacity) >= made.least


def test_search_betters_best_fit():
    """Best-fit decreasing needs three bins of 10 for these, the search two."""
    counts = np.bincount([5, 4, 4, 3, 2, 2], minlength=11)
    assert sum(n for _, n in bestfit.best_fit(counts, 10)) == 3 and bestfit.plan(counts, 10).bins == 2


def test_plan_grows_with_lengths_not_with_counts():
    counts = np.bincount(np.random.default_rng(0).integers(1, 1025, 5000), minlength=1025)
    small, large = bestfit.plan(counts, 1024), bestfit.plan(counts * 10**7, 1024)
    check(large.fillings, counts * 10**7, 1024)
    assert len(large.fillings) < 4 * len(small.fillings) and large.bins <= 1.01 * large.least
    none = bestfit.plan(np.zeros(1025, int), 1024)
    assert none.bins == 0 and none.fillings == []


def test_ids_are_the_tokenizers(spark):
    rng = random.Random(5)
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    bits = ["a", "Être", "don't", "'s", " ", "  ", "\n", "\n\n", "\t", "12", "²", "...", "<|endoftext|>", "<|", "汉字", " ", "é", "ǅ", "\x1c", "_x", "#!", "'LL", "\r\n", "ß"]
    texts += ["", " ", "\n", "a", " a", "a ", "<|endoftext|>"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    own, real = bestfit.ByteEncoder(PATH, keep=5000), Tokenizer.from_file(PATH)
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        got = own.all(part)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [real.encode(t, add_special_tokens=False).ids for t in part]


def packed(spark, docs):
    real = Tokenizer.from_file(PATH)
    ids = {i: [*real.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs.select("doc_id", "text").collect()}
    rows = bestfit.pack_uncut(docs, PATH).collect()
    own, bins = {}, {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and len(part) == 4 * r.length > 0
    for i, ps in own.items():
        ps.sort(key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps))) and [p.start for p in ps] == np.cumsum([0, *(p.length for p in ps[:-1])]).tolist()
        assert sum(p.length for p in ps) == len(ids[i]) and all(p.length == 1024 for p in ps[1:]) and len(ps) == -(-len(ids[i]) // 1024)
    assert own.keys() == ids.keys() and sorted(bins) == list(range(len(bins)))
    for ps in bins.values():
        ps.sort(key=lambda r: r.offset)
        assert [p.offset for p in ps] == np.cumsum([0, *(p.length for p in ps[:-1])]).tolist() and sum(p.length for p in ps) <= 1024
    return bins, ids


def test_query_keeps_its_contract_and_packs_tightly(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bins, ids = packed(spark, docs.repartition(7))
    assert len(bins) <= 1.003 * -(-sum(map(len, ids.values())) // 1024)
    again = queries.op12_best_fit(spark, SF)
    assert again.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert again.select("sequence_id").distinct().count() == len(bins)  # however the table is split


def test_odd_rows(spark):
    rows = [(1, None, 0.5, "x"), (2, "", 1.0, "y"), (3, "é" * 40_000, None, None), (4, "one two  three\n", 0.0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length double, sequence_id string")
    bins, ids = packed(spark, docs)
    assert len(ids[1]) == len(ids[2]) == 1 and len(ids[3]) > 1024
    twice = bestfit.pack_uncut(docs.unionAll(docs).unionAll(docs.withColumn("doc_id", F.lit(None).cast("long"))), PATH)
    n = {r.doc_id: r.n for r in twice.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert n == {i: 2 * len(x) for i, x in ids.items()} | {None: sum(map(len, ids.values()))}
    assert bestfit.pack_uncut(docs.limit(0), PATH).count() == 0
