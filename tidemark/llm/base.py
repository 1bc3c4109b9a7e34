"""What the operators of this subpackage share: the shared folder, written cut points and word rules."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


_own: dict[str, str] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where a local session has none, a temporary one (tests).

    On a cluster without that setting there is no such folder to guess, and this raises an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tidemark-")
        found = _own[app]
    return found.rstrip("/")


_open: contextvars.ContextVar[Scratch | None] = contextvars.ContextVar("scratch", default=None)


class Scratch:
    """Tables written while it is open, to be removed at its end unless kept."""

    def __init__(self) -> None:
        self.paths: dict[str, SparkSession] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.pop(df._written, None)
        return df


@contextlib.contextmanager
def scratch() -> Iterator[Scratch]:
    """Removes what was written inside, once nothing outside depends on it: keep() what the result still reads."""
    own = Scratch()
    token = _open.set(own)
    try:
        yield own
    finally:
        _open.reset(token)
        for path, spark in own.paths.items():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, kind: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    A lost executor costs the recomputation of nothing before this point. Column types survive; row order does not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if (now := _open.get()) is not None:
        now.paths[path] = spark
    return out


def few(keys: DataFrame, most: int = 200_000) -> DataFrame:
    """keys, to be broadcast where they are counted to be at most `most` short rows, else for a merge join."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys.hint("merge")


def attach(left: DataFrame, right: DataFrame, key: str, weight: Column, most: int = 20_000) -> DataFrame:
    """left with right's columns where its key has them (right has a row a key): a left join that no key can crowd.

    weight: how many rows of left have the key, of which only the proportions count. Keys with over one `most`-th of all
    weight are fewer than `most`, so they are broadcast; every other key is a small part of a merge join.
    """
    own = [c for c in right.columns if c != key]
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), key, "left").select(*left.columns, *own)
    bar = (right.agg(F.sum(weight)).first()[0] or 0.0) / most
    heavy = right.where(weight > bar).select(key, F.struct(*own).alias("__heavy"))
    light = right.where(~(weight > bar)).select(F.col(key).cast("string").alias("__key"), F.struct(*own).alias("__light"))
    out = left.join(F.broadcast(heavy), key, "left")
    # rows that are served already, and those without a key, are spread over the tasks of the merge join
    away = F.concat(F.lit("\0"), (F.monotonically_increasing_id() % 100_003).cast("string"))
    out = out.withColumn("__key", F.when(F.col(key).isNotNull() & F.col("__heavy").isNull(), F.col(key).cast("string")).otherwise(away))
    out = out.join(light.hint("merge"), "__key", "left")
    return out.select(*left.columns, *[F.coalesce(F.col(f"__heavy.{c}"), F.col(f"__light.{c}")).alias(c) for c in own])


def n_words(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the decimal doc_id, modulo folds; fold 0 is held out. A null doc_id is fold 0 (never learnt from)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(folds), F.lit(0)).cast("int")
