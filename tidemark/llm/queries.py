"""The registered queries: each operator over its whole table, as the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, divergence, extraction, language, mixing, neighbours, packing, quality, repair, rules, simhash, suffixes, toxicity
from .base import crc_fold, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.ledger(table(spark, sf_dir, "documents"))
    base = ~rules.passes(F.col("failed"), "base")
    return book.select("doc_id", *rules.MEASURES[:5], base.alias("base_failed"), (~base & rules.passes(F.col("failed"), "v1")).alias("kept"), "failed", F.lit("v1").alias("policy"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return near.select("query_id", "rank", "vec_id", "score")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations uncut, under limits that pull apart: tokens, conversations and tokens of the assistant."""
    examples = packing.instruction_examples(table(spark, sf_dir, "conversations"), tokenizer_path())
    return packing.pack_examples(examples, packing.Limits(tokens=4096, segments=16, loss=2048))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_uncut(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash": op3_simhash,
    "op4_language_id": op4_language_id,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_best_fit": op12_best_fit,
    "op13_divergence": op13_divergence,
    "instruction_packing": instruction_packing,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]', '', 'g')) AS low, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS k FROM m, unnest(range(1, len(w) - 6)) AS r(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY 1),
b AS (SELECT m.doc_id, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(lines) AS n_lines, up, low, digits FROM m LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, n_words < 20 AS r0, 100 * n_repeat_words > 30 * n_words AS r1, 10 * n_symbols > 3 * n_words AS r2, n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines AS r3, word_chars < 2 * n_words OR word_chars > 20 * n_words AS r4,
  up + low >= 20 AND 100 * up > 60 * (up + low) AS r5, 100 * digits > 30 * word_chars AS r6 FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 OR r1 AS base_failed, NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5 OR r6) AS kept,
  r0::BIGINT + 2 * r1::BIGINT + 4 * r2::BIGINT + 8 * r3::BIGINT + 16 * r4::BIGINT + 32 * r5::BIGINT + 64 * r6::BIGINT AS failed, 'v1' AS policy FROM r""",
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS whole FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(own, 0)::HUGEINT AS own FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS own FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (own + 2 * v) AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (whole + 2 * v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 10""",
    "op11_conversation_repair": r"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)), lambda h, b:
    list_reduce(list_prepend(xor(h, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS h FROM conversations),
kind AS (SELECT *, xor(h, 4294967295) % 20 AS k FROM raw),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM kind, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS c(x) WHERE k > 0),
p AS (SELECT *, row_number() OVER w AS i, substr(role, 1, 1) AS ini, lag(substr(role, 1, 1)) OVER w AS prev FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM p),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM o),
n AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated, count_if(prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
ins(q, q2, edits, lines) AS (VALUES ('n', 'n', '', []::VARCHAR[]), ('s', 's', '', []), ('u', 'u', '', []), ('a', 'a', '', []), ('n', 'u', 'I', ['user:']), ('s', 'u', 'I', ['user:']), ('a', 'u', 'I', ['user:']), ('u', 'a', 'I', ['assistant:']), ('n', 'a', 'II', ['user:', 'assistant:']), ('s', 'a', 'II', ['user:', 'assistant:'])),
arc(q2, edit, ini, q3, cost) AS (SELECT q2, 'D', NULL::VARCHAR, q2, 4 FROM (VALUES ('n'), ('s'), ('u'), ('a')) AS x(q2) UNION ALL SELECT q2, 'R', NULL::VARCHAR, CASE q2 WHEN 'u' THEN 'a' ELSE 'u' END, 3 FROM (VALUES ('n'), ('s'), ('u'), ('a')) AS x(q2)
  UNION ALL VALUES ('n', 'K', 's', 's', 0), ('n', 'K', 'u', 'u', 0), ('s', 'K', 'u', 'u', 0), ('a', 'K', 'u', 'u', 0), ('u', 'K', 'a', 'a', 0)),
v AS (SELECT conv_id, 0::BIGINT AS i, 'n' AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM n
  UNION ALL SELECT conv_id, i, q, cost, audit, lines FROM (SELECT f.conv_id, f.i, arc.q3 AS q, v.cost + 3 * length(ins.edits) + arc.cost + CASE WHEN arc.edit <> 'D' AND f.fault = 't' THEN 3 ELSE 0 END AS cost, v.audit || ins.edits || arc.edit AS audit,
    v.lines || ins.lines || CASE arc.edit WHEN 'K' THEN [f.role || ':' || f.text] WHEN 'R' THEN [CASE arc.q3 WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text] ELSE []::VARCHAR[] END AS lines
    FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1 JOIN ins ON ins.q = v.q JOIN arc ON arc.q2 = ins.q2 AND (arc.ini IS NULL OR arc.ini = f.ini) AND (arc.edit = 'D' OR f.fault NOT IN ('b', 'd')))
    QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
done AS (SELECT v.conv_id, v.cost + 3 * length(ins.edits) AS cost, v.audit || ins.edits AS audit, v.lines || ins.lines AS lines FROM v JOIN n ON n.conv_id IS NOT DISTINCT FROM v.conv_id AND n.rows = v.i JOIN ins ON ins.q = v.q AND ins.q2 IN ('n', 'a') WHERE NOT (ins.q = 'n' AND ins.q2 = 'a')
  QUALIFY row_number() OVER (PARTITION BY v.conv_id ORDER BY v.cost + 3 * length(ins.edits), v.audit || ins.edits) = 1)
SELECT c.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank, coalesce(n.duplicate, 0)::BIGINT AS duplicate, coalesce(n.truncated, 0)::BIGINT AS truncated, coalesce(n.illegal, 0)::BIGINT AS illegal, coalesce(done.cost, 0)::BIGINT AS cost, coalesce(done.audit, '') AS audit,
  sha256(coalesce(array_to_string(done.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
