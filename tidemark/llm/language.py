"""Language identification by Bayesian evidence fusion.

The posterior over languages of a page multiplies four kinds of evidence: the likelihood of its text under letter-n-gram
models, the language its markup declares, the suffix of its address, and a prior of its host. How far declarations and
suffixes can be trusted is learnt from the corpus: they are tabulated against the languages the texts alone show. A
host's prior is smoothed by its domain's, and that by the corpus': a host with few pages speaks mostly for its domain. A
page's own share is taken out of the tables before they speak for it, so that its text counts once. All tables are grouped sums over every document and page, combined on the map side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import attach, scratch, written
from .extraction import extract

BUCKETS = 1 << 14  # of letter trigrams; the models' size, whatever the corpus'
_LETTERS = re.compile(r"[\W\d_]+")
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?\s*([A-Za-z]{2,3})\b""", re.I)
_META = re.compile(r"""<meta\b[^>]*?(?:http-equiv\s*=\s*["']?content-language["']?[^>]*?content|property\s*=\s*["']?og:locale["']?[^>]*?content)\s*=\s*["']?\s*([A-Za-z]{2,3})\b""", re.I)


def buckets(text: str | None) -> np.ndarray:
    """Hashed letter trigrams of a whole text, words padded by a space."""
    clean = f" {_LETTERS.sub(' ', (text or '').lower())} "
    c = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x27D4EB2F165667C5)
    return (h >> np.uint64(50)).astype(np.int64)


def declared_language(html: str | None) -> str | None:
    """The language the markup declares, as two or three lower-case letters."""
    m = _LANG.search(html or "") or _META.search(html or "")
    return m[1].lower() if m else None


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            b = buckets(text.as_py())
            if len(b):
                total[lang] += np.bincount(b, minlength=BUCKETS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])


def primary(tag: Column) -> Column:
    """The primary subtag of a language tag (en of en-GB), two or three lower-case letters; null if there is none."""
    found = F.regexp_extract(F.lower(F.trim(tag)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(found != "", found)


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of trigram buckets under each, from every labelled document.

    docs: (lang, text). Counts cover all documents and every language of theirs, region tags taken together. The model holds
    languages x BUCKETS numbers: as many as there are language codes in use, however many rows. Documents without a
    language are not counted.
    """
    with scratch():
        counts = docs.select(primary(F.col("lang").cast("string")).alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL").mapInArrow(_count, "lang string, bucket bigint, n bigint")
        got = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # one row per language and bucket
    langs = sorted(set(got.lang))
    place = {x: i for i, x in enumerate(langs)}
    model = np.full((len(langs), BUCKETS), 0.5)
    model[[place[x] for x in got.lang], got.bucket.to_numpy(np.int64)] += got.n.to_numpy(float)
    return langs, np.log(model / model.sum(1, keepdims=True))


def _likelihoods(langs: list[str], model: np.ndarray, temper: float):
    columns = np.ascontiguousarray(model.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 1
            text_ll, declared = [], []
            for page in batch.column(k):
                html = page.as_py()
                b = buckets(extract(html))
                ll = columns[b].sum(0) if len(b) else np.zeros(len(langs))
                text_ll.append(((ll - ll.max()) / max(1.0, len(b)) * min(len(b), temper)).tolist() if len(langs) else [])
                declared.append(declared_language(html))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(text_ll, pa.list_(pa.float64())), pa.array(declared, pa.string())], names=[*batch.schema.names[:k], "text_ll", "declared"])

    return run


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or a leading www; null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def _softmax(log: Column) -> Column:
    return F.transform(F.transform(log, lambda x: F.exp(x - F.array_max(log))), lambda e: e / F.aggregate(F.transform(log, lambda x: F.exp(x - F.array_max(log))), F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, docs: DataFrame, temper: float = 60.0, strength: float = 8.0, smoothing: float = 1.0) -> DataFrame:
    """page_id, url, host, declared, suffix, text_lang, lang, posterior (of lang): one row per row of pages.

    temper: letters' worth of evidence that a text gives at most (trigrams are not independent). strength: pages of a
    parent that a host's or domain's prior starts from. smoothing: of the counts of declarations and suffixes. A null html or url, or one without a host, leaves that evidence
    out; with none at all the corpus' prior decides. Without any labelled document lang is null. Repeated rows stay; ties
    go to the first language of the alphabet; columns not named are not read.
    """
    langs, model = fit(docs)
    n = len(langs)
    base = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("__html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    seen = base.mapInArrow(_likelihoods(langs, model, temper), f"page_id {kind}, url string, text_ll array<double>, declared string")
    if not n:
        return seen.select("page_id", "url", host_of(F.col("url")).alias("host"), "declared", F.element_at(F.split(host_of(F.col("url")), r"\."), -1).alias("suffix"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"))
    host = host_of(F.col("url"))
    seen = seen.withColumn("host", host).withColumn("suffix", F.element_at(F.split("host", r"\."), -1)).withColumn("domain", F.substring_index("host", ".", -2))
    seen = written(seen.withColumn("p", _softmax(F.col("text_ll"))), "lang-pages")
    summed = lambda: F.array(*[F.sum(F.col("p")[i]) for i in range(n)])
    grouped = lambda *keys: seen.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(summed().alias(f"{keys[0]}_n"))
    total = np.array([x or 0.0 for x in seen.agg(summed().alias("t")).first().t], float)
    corpus = F.array(*[F.lit(float(x)) for x in (total + smoothing) / (total + smoothing).sum()])
    others = lambda counts: F.zip_with(counts, F.col("p"), lambda c, q: F.greatest(c - q, F.lit(0.0)))  # noqa: E731  a page is no evidence for itself
    # corpus -> domain -> host, each shrunk to its parent by `strength` pages
    add_up = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    shrink = lambda counts, parent: F.zip_with(counts, parent, lambda c, q: (c + q * strength) / (add_up(counts) + strength))
    hosts = grouped("host", "domain").join(grouped("domain"), "domain").select("host", "host_n", "domain_n")

    # P(declared | language) and P(suffix | language), with room for values never seen
    def given(key: str) -> DataFrame:
        of = grouped(key)
        kinds = of.agg(F.count(F.lit(1)).alias(f"{key}_kinds"), F.array(*[F.coalesce(F.sum(F.col(f"{key}_n")[i]), F.lit(0.0)) for i in range(n)]).alias(f"{key}_t"))
        return of.crossJoin(F.broadcast(kinds))  # kinds is one row

    def evidence(key: str) -> Column:
        of = F.zip_with(others(F.col(f"{key}_n")), others(F.col(f"{key}_t")), lambda c, t: F.log((c + smoothing) / (t + smoothing * (F.col(f"{key}_kinds") + 1))))
        return F.when(F.col(f"{key}_n").isNotNull(), of).otherwise(none)

    none = F.array(*[F.lit(0.0)] * n)
    out = attach(seen, hosts, "host", add_up(F.col("host_n")))
    for key in ("declared", "suffix"):
        out = attach(out, given(key), key, add_up(F.col(f"{key}_n")))
    out = out.withColumn("domain_p", shrink(others(F.col("domain_n")), corpus)).withColumn("host_p", shrink(others(F.col("host_n")), F.col("domain_p")))
    out = out.withColumn("declared_ll", evidence("declared")).withColumn("suffix_ll", evidence("suffix"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    log = add(add(F.col("text_ll"), F.transform(F.coalesce("host_p", corpus), lambda x: F.log(x))), add(F.col("declared_ll"), F.col("suffix_ll")))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda values: F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))
    out = out.withColumn("posteriors", _softmax(log))
    has_text = F.exists("text_ll", lambda x: x != 0)
    return out.select("page_id", "url", "host", "declared", "suffix", F.when(has_text, best(F.col("text_ll"))).alias("text_lang"), best(F.col("posteriors")).alias("lang"), F.array_max("posteriors").alias("posterior"))
