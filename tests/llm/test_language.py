"""Fusion against the formula written out, tags of regions, ties and long texts."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.llm import base, language
from tidemark.llm.extraction import extract

SCHEMA = "page_id long, url string, html string, lang string"


def brute(pages, langs, model, temper=60.0, strength=8.0, smoothing=1.0):
    rows = []
    for _, url, html, _ in pages:
        b = language.buckets(extract(html))
        ll = model[:, b].sum(1) if len(b) else np.zeros(len(langs))
        ll = (ll - ll.max()) / max(1, len(b)) * min(len(b), temper)
        p = np.exp(ll - ll.max())
        host = url.split("//")[1].split("/")[0].removeprefix("www.") if url else None
        rows.append((ll, p / p.sum(), host, ".".join(host.split(".")[-2:]) if host else None, host.split(".")[-1] if host else None, language.declared_language(html)))
    sums = defaultdict(lambda: np.zeros(len(langs)))
    for _, p, host, domain, suffix, declared in rows:
        for key in (("h", host), ("d", domain), ("s", suffix), ("l", declared)):
            if key[1]:
                sums[key] += p
    total = sum(r[1] for r in rows) + smoothing
    corpus, out = total / total.sum(), []
    shrink = lambda c, q: (c + q * strength) / (c.sum() + strength)
    for ll, p, host, domain, suffix, declared in rows:
        prior = corpus
        if host:
            prior = shrink(sums["h", host] - p, shrink(sums["d", domain] - p, corpus))
        log = ll + np.log(prior)
        for kind, value in (("s", suffix), ("l", declared)):
            if value:
                of = [v for (k, _), v in sums.items() if k == kind]
                log = log + np.log((sums[kind, value] - p + smoothing) / (sum(of) - p + smoothing * (len(of) + 1)))
        post = np.exp(log - log.max())
        out.append((langs[int(post.argmax())], post.max() / post.sum()))
    return out


def test_fusion_equals_the_formula(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("page_id", "url", "html", "'x'").orderBy("page_id").limit(120).collect()]
    pages = [(i, u, h, x) for i, (_, u, h, x) in enumerate(pages)] + [(900, None, "<p>the thing that is of and</p>", "x"), (901, "http://one.example.zz/", None, "x"), (902, "http://one.example.zz/", "<html lang=de><p>und der die</p>", "x")]
    langs, model = language.fit(docs)
    got = {r.page_id: (r.lang, r.posterior) for r in language.identify(spark.createDataFrame(pages, SCHEMA), docs).collect()}
    for page, (lang, p) in zip(pages, brute(pages, langs, model)):
        assert got[page[0]][0] == lang and got[page[0]][1] == pytest.approx(p, abs=1e-6)


def test_a_page_is_no_evidence_for_itself(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = "<p>the thing that is of and</p>"
    pages = [(1, "http://solo.alone.qq/", text, "x"), (2, None, text, "x")]
    got = {r.page_id: r.posterior for r in language.identify(spark.createDataFrame(pages, SCHEMA), docs).collect()}
    assert got[1] == pytest.approx(got[2], abs=0.02)


def test_every_language_is_modelled_and_regions_are_one(spark):
    codes = [a + b for a in "abcdefghij" for b in "abcdefghij"]
    rows = [(c, f"{c * 9} {c}") for c in codes] + [("en-US", "colour"), (" EN_gb ", "colour"), ("en", "x"), ("nonsense tag", "y"), (None, "z")]
    langs, model = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert set(langs) == set(codes) | {"en"} and model.shape == (len(langs), language.BUCKETS)


def test_long_repeated_and_tied_pages(spark):
    docs = spark.createDataFrame([("aa", "qqq www"), ("bb", "qqq www")], "lang string, text string")  # nothing tells them apart
    rows = [(1, "http://x.yy/", "<p>" + "qqq www " * 40_000 + "</p>", "x")] * 2 + [(2, "http://x.yy/", "", "x")]
    got = language.identify(spark.createDataFrame(rows, SCHEMA), docs).collect()
    assert Counter(r.page_id for r in got) == {1: 2, 2: 1} and {r.lang for r in got} == {"aa"} and all(math.isclose(r.posterior, 0.5) for r in got)


@pytest.mark.parametrize("most", [1, 3, 10, 1000])
def test_attaching_is_a_left_join_however_keys_are_served(spark, most):
    left = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(300)], "i int, k string").repartition(5)
    right = spark.createDataFrame([("hot", 200.0, "h"), *[(f"k{i}", 1.0, f"v{i}") for i in range(0, 150, 6)]], "k string, n double, v string")
    got = base.attach(left, right, "k", F.col("n"), most)
    assert got.columns == ["i", "k", "n", "v"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(right, "k", "left").select("i", "k", "n", "v").collect()), key=str)
