"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every document gets a number of copies: the whole part of target / source size, plus a fraction that is rounded.
The fractions are not rounded one by one. Two documents of a source meet, and words are moved from one to the other
until one of them is wholly taken or wholly left; which way the words move is random, with odds that keep each
document's expectation. The words of the pair stay the same in sum, so a source misses its target only by the very
last fraction. Each bucket of about `fan` documents is folded this way and leaves one fractional document; these meet
again in the next level's buckets, and so on: a reduction tree whose levels shrink by `fan`, with no task that sees a
whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import n_words, scratch, written

UNIT = "struct<uid:bigint,doc_id:bigint,size:bigint,row:bigint,source_size:bigint,target:double,base:bigint,p:double>"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources: (source, n, source_size, target).

    sizes: (source, size) per document. Sources in code point order, a null source last, weigh `weights` in turn and share
    `share` times all words; a target stops at `most` times its source's words and the excess is shared by weight among
    the rest. The fixed point is a water level: target = least(cap, level * weight), found with two cumulative sums over
    the sources (one row each), not by repeated resharing. Sources without words get 0.
    """
    stats = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = stats.select(
        "*",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).alias("w"),
        (F.col("source_size") * most).alias("cap"),
        (F.sum("source_size").over(everything) * share).alias("total"),
    )
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.select(
        "*",
        (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_left"),
    ).withColumn("level", F.col("left") / F.col("w_left"))
    level = F.max(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.col("level"))).over(everything)
    return levels.select("source", "n", "source_size", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def _draw(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _meet(seed: int, state: Column, x: Column) -> Column:
    """One pivotal step of the fold: the carried unit meets x; the one that is settled joins the list."""
    cur = state["carry"]
    a, b, sa, sb = cur["p"], x["p"], cur["size"].cast("double"), x["size"].cast("double")
    up, down = F.least((1 - a) * sa, b * sb), F.least(a * sa, (1 - b) * sb)  # words that can move to the carry, from it
    to_carry = _draw(seed, cur["uid"], x["uid"]) * (up + down) < down
    a2 = F.when(to_carry, F.when((1 - a) * sa <= b * sb, F.lit(1.0)).otherwise(a + b * sb / sa)).otherwise(F.when((1 - b) * sb <= a * sa, F.greatest(a - (1 - b) * sb / sa, F.lit(0.0))).otherwise(F.lit(0.0)))
    b2 = F.when(to_carry, F.when((1 - a) * sa <= b * sb, F.greatest(b - (1 - a) * sa / sb, F.lit(0.0))).otherwise(F.lit(0.0))).otherwise(F.when((1 - b) * sb <= a * sa, F.lit(1.0)).otherwise(b + a * sa / sb))
    with_p = lambda u, p: F.struct(*[p.alias("p") if k == "p" else u[k].alias(k) for k in ("uid", "doc_id", "size", "row", "source_size", "target", "base", "p")])
    pair = F.array(with_p(cur, a2), with_p(x, b2))
    settled = F.when((a2 == 0.0) | (a2 == 1.0), 1).otherwise(2)
    return F.when(cur.isNull(), F.struct(x.alias("carry"), state["done"].alias("done"))).otherwise(
        F.struct(F.element_at(pair, 3 - settled).alias("carry"), F.concat(state["done"], F.array(F.element_at(pair, settled))).alias("done"))
    )


def _fold(units: DataFrame, seed: int) -> DataFrame:
    """units: (source, bucket, unit) -> (source, bucket, carry, done): each bucket folded in hash order."""
    some = units.groupBy("source", "bucket").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "unit.uid").alias("h"), "unit"))).alias("all"))
    start = F.struct(F.lit(None).cast(UNIT).alias("carry"), F.array().cast(f"array<{UNIT}>").alias("done"))
    folded = F.aggregate(F.transform("all", lambda x: x["unit"]), start, lambda state, x: _meet(seed, state, x))
    return some.select("source", "bucket", folded.alias("f")).select("source", "bucket", "f.carry", "f.done")


def pivotal_copies(rows: DataFrame, seed: int = 17, fan: int = 32) -> DataFrame:
    """Copies of each document, by pivotal dependent rounding down a reduction tree.

    rows: (row, uid, doc_id, source, size, n, source_size, target); uid deals the rows and their draws, n is the source's
    documents. Returns (row, uid, doc_id, size, source_size, target, copies). Documents without words get no copies. A row that no
    fraction touches keeps its whole part. The same uids give the same copies.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.when(F.abs(ratio - F.round(ratio)) < 1e-12, F.round(ratio)).otherwise(ratio)
    units = rows.withColumn("r", near).select(
        "source",
        F.pmod(F.xxhash64(F.lit(seed), "uid"), F.greatest(F.ceil(F.col("n") / fan), F.lit(1))).alias("bucket"),
        "n",
        F.struct("uid", "doc_id", "size", "row", "source_size", "target", F.floor("r").cast("long").alias("base"), (F.col("r") - F.floor("r")).alias("p")).alias("unit"),
    )
    units = written(units, "mix-units")
    fractional = (F.col("unit.p") > 0) & (F.col("unit.size") > 0)
    whole = units.where(~fractional).select("unit.*")
    done = [whole.select("row", "uid", "doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("base")).otherwise(F.lit(0).cast("long")).alias("copies"))]
    n = units.agg(F.max("n")).first()[0] or 0
    left, buckets = units.where(fractional).select("source", "bucket", "unit"), math.ceil(n / fan)
    settled = lambda df: df.select("row", "uid", "doc_id", "size", "source_size", "target", (F.col("base") + F.round("p").cast("long")).alias("copies"))
    while True:
        level = written(_fold(left, seed), "mix-level")
        done.append(settled(level.select(F.explode("done").alias("u")).select("u.*")))
        if buckets <= 1:
            break
        buckets = math.ceil(buckets / fan)
        left = level.select("source", F.floor(F.col("bucket") / fan).alias("bucket"), F.col("carry").alias("unit"))
    last = level.select("source", "carry.*").withColumn("p", F.when(_draw(seed + 1, F.col("source")) < F.col("p"), F.lit(1.0)).otherwise(F.lit(0.0)))
    done.append(settled(last))
    out = done[0]
    for x in done[1:]:
        out = out.unionAll(x)
    return out


def numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with uid: a hash of the key columns and of the row's place among the rows with the same key.

    rows have row, a number that is the same whenever they are read and whose upper bits name the task that gave it. Equal
    rows may change places without anything changing, so uid depends on what the rows hold, not on how they are split or
    ordered. A key that many rows share is counted task by task; only one row per key and task is brought together.
    """
    cells = [c for k in key for c in (F.col(k), F.col(k).isNull())]
    keys = ["__a", "__b"]  # 128 bits of the key
    local = rows.select("*", F.xxhash64(F.lit(1), *cells).alias("__a"), F.xxhash64(F.lit(2), *cells).alias("__b"), F.shiftright("row", 33).alias("__part"))
    local = local.withColumn("__at", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("row")))
    counts = local.groupBy(*keys, "__part").agg(F.max("__at").alias("__n"))
    order = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    later = counts.withColumn("__before", F.sum("__n").over(order)).where("__before > 0")
    place = F.col("__at") + F.coalesce("__before", F.lit(0))
    return local.join(later.select(*keys, "__part", "__before"), [*keys, "__part"], "left").withColumn("uid", F.xxhash64(*keys, place)).select(*rows.columns, "uid")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 17, fan: int = 32) -> DataFrame:
    """(row, uid, doc_id, size, source_size, target, copies) of documents with columns doc_id, source and text.

    Null texts have size 0 and get no copies; null sources are one source, ranked last; repeated rows are documents of
    their own; an empty table gives no rows. Other columns are not read. The same rows give the same copies, however they
    are split into files and tasks: what is drawn depends on doc_id, source, size (and __print, where docs has it) and on
    the place among rows that agree in them, which are as good as each other. row is docs' __row, or a number of this run.
    """
    row = F.col("__row") if "__row" in docs.columns else F.monotonically_increasing_id()
    extra = [F.col("__print").alias("print")] if "__print" in docs.columns else []
    sized = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), *extra)
    sized = written(sized, "mix-sizes")
    targets = source_targets(sized.select("source", "size"), weights, share, most).withColumnRenamed("source", "of_source")
    rows = numbered(sized, ["doc_id", "source", "size", *(["print"] if extra else [])])
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    return pivotal_copies(rows, seed, fan)


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (not at all, once or more), all columns kept.

    Rows that differ in any column of a simple type are told apart by it, so that the same rows give the same mix however
    they are split. Nulls, repeated rows and empty tables are as in mix.
    """
    with scratch() as temp:
        simple = [F.col(c) for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
        base = docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__print", F.xxhash64(*simple))
        base = temp.keep(written(base, "mix-docs"))  # one numbering for both uses
        copies = temp.keep(written(mix(base, **how).where("copies > 0").select(F.col("row").alias("__row"), F.col("copies").alias("__copies")), "mix-copies"))
    taken = base.join(copies.hint("merge"), "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return taken.select(*docs.columns)
