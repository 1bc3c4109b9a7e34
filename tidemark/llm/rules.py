"""Quality rules as a bitmask ledger.

All rules are measured and judged once per document. The ledger keeps each document's measurements and one long whose
bit i says that rule i failed. Policies are versioned bit masks: applying one, changing one, or finding what each of its
rules costs (ablation) is integer arithmetic over the ledger and never reads a text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters counted as symbols, and white space that is no word.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_distinct_words")

#: Rules in bit order: name, and the condition (SQL over MEASURES) under which a document fails. Append only.
RULES = (
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols_per_word", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("mean_word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("upper_case", "n_upper + n_lower >= 20 and 100 * n_upper > 60 * (n_upper + n_lower)"),
    ("digits", "100 * n_digits > 30 * word_chars"),
)

#: Versioned policies: the rules of each, by name.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols_per_word", "repeated_lines", "mean_word_length", "upper_case", "digits"),
}


def policy_mask(policy: str | tuple[str, ...]) -> int:
    names = [r[0] for r in RULES]
    return sum(1 << names.index(x) for x in (POLICIES[policy] if isinstance(policy, str) else policy))


def _repeat_words(ids: np.ndarray, width: int) -> int:
    """Words covered by a width-word window that is found twice or more (width a power of two); exact."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key, step = ids, 1
    while step < width:  # names of windows twice as long, until equal names mean equal windows
        pair = key[:-step] * (int(key.max()) + 1) + key[step:]
        key = np.unique(pair, return_inverse=True)[1]
        step *= 2
    again = np.bincount(key)[key] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += again
    edge[width:] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure_text(text: str | None, width: int = 8) -> tuple[int, ...]:
    """MEASURES of one text; a null text is empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space, exactly the word rule
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(bytes_[0x80:0xC0].sum())  # continuation bytes are no code points
    total = lambda of: int(bytes_[list(of.encode())].sum())
    return (
        len(words), points - total(SPACES), total(SYMBOLS), dup, _repeat_words(ids, width), lines,
        int(bytes_[65:91].sum()), int(bytes_[97:123].sum()), int(bytes_[48:58].sum()), len(names),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = list(zip(*(measure_text(t.as_py()) for t in batch.column(batch.num_columns - 1)))) or [()] * len(MEASURES)
        arrays = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(c, pa.int64()) for c in cols]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], *MEASURES])


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep + MEASURES + failed (long): one row per row of docs, whole texts, one pass, no shuffle.

    A null or empty text measures 0 throughout (it fails too_few_words). Columns not named are not read, so that
    clashing names among them do no harm. Repeated rows stay; an empty table gives no rows.
    """
    rows = docs.select(*[F.col(k) for k in keep], F.col(text).cast("string").alias("__text"))
    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep] + [f"{m} bigint" for m in MEASURES])
    measured = rows.mapInArrow(_measure, schema)
    bits = sum((F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, cond) in enumerate(RULES)), F.lit(0))
    return measured.withColumn("failed", bits.cast("long"))


def passes(failed: Column, policy: str | tuple[str, ...]) -> Column:
    """Whether a document with these failure bits is kept under a policy."""
    return failed.bitwiseAND(F.lit(policy_mask(policy))) == 0


def ablations(entries: DataFrame, policy: str | tuple[str, ...]) -> DataFrame:
    """One row per rule of the policy: documents that fail it, that only it removes, and kept without it.

    One grouped count over distinct bit masks (partial on the map side), then sums over at most 2^rules rows.
    """
    mask = policy_mask(policy)
    by_bits = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (r, _) in enumerate(RULES) if mask >> i & 1]))
    return (
        by_bits.select("bits", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("r.bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )
