"""The corpus pipeline: quality classifier, near-duplicates, repeated passages, mixing, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame, is written as Parquet and read again as the next stage's docs. All but
the last return the columns of documents (doc_id, text, lang, source, n_chars).

Nulls may stand in any column, further columns of docs are dropped, repeated rows are documents of their own, texts of any
length are taken whole, and an empty table gives an empty table. Each stage says what it does beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, quality, simhash, suffixes
from tidemark.llm.base import WORD, table, written
from tidemark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A document is rejected below this score.
QUALITY = 0.3

#: Repeated passages of over so many words go; the shortest has PASSAGE + 1 letters and PASSAGE spaces.
PASSAGE = 50

#: Bytes that decide where such a passage is anchored: the fewer, the fewer anchors; the more, the fewer of them by chance.
GRAM = 32


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier, fitted on these docs, scores at QUALITY or more.

    Equal texts have equal scores. Null and empty texts are scored as texts without words. Where nothing can be fitted (no
    trusted positive or no unlabelled text) all documents stay.
    """
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, net, QUALITY).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: candidates by the deletion variants of their fingerprints'
    segments, and of these the pairs whose sets of five-word shingles are really alike at 0.8 or more.

    Of a group the smallest doc_id stays; a null doc_id comes last; of rows with one doc_id the first read. Texts without
    words, null ones too, are one group.
    """
    return simhash.one_of_each(docs, width=5).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages of over PASSAGE words; documents of which no word is left go.

    Every copy of a passage goes, so rows that repeat each other go wholly; null and word-less texts go too.
    """
    left = suffixes.remove_repeats(docs, ("doc_id", "lang", "source"), length=2 * PASSAGE + 1, gram=GRAM, rewrite=True, words=PASSAGE)
    return left.where(F.col("text").rlike(WORD)).select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes: rows without a copy go, rows with two are there twice.

    Rows without words, null texts too, have no copy; a null source is a source, ranked last. The same rows give the same mix.
    """
    return mixing.mixed_rows(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; one row per piece. A null or empty text is the end id alone."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-duplicates", near_duplicates),
    ("suffix dedup", suffix_dedup),
    ("mixing", mixing_sources),
    ("packing", pack),
]

#: The classifier, fingerprints and tokenizer are not expressible in SQL; tests hold near-duplicates, repeated passages, the mix
#: and packing against brute force or round trips, the classifier against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
