"""Resumable work: a store of finished keys in versions, and stream batches that count once.

The store is a folder of versions, each a whole Parquet table, complete once its folder has its final name. A write makes
the next version under a name of its own and renames it: a reader sees the version before or the one after, never a part,
and a writer that is killed leaves only a folder that the next one clears. Batches are numbered by the stream; a version
records the last one that is in it, so a batch that is run again after a crash changes nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Store:
    """Rows by key, of which the newest stays. schema: DDL with the key columns."""

    _NAME = re.compile(r"version=(\d+)-batch=(-?\d+)$")

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], keep: int = 3):
        self.spark, self.path, self.schema, self.keys, self.keep = spark, path.rstrip("/"), schema, keys, keep
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(root)

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[tuple[int, int, str]]:
        """(version, last batch, folder), oldest first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted((int(m[1]), int(m[2]), n) for n in names if (m := self._NAME.fullmatch(n)))

    def rows(self) -> DataFrame:
        """The newest version; empty before the first."""
        found = self.versions()
        read = self.spark.read.schema(self.schema)
        return read.parquet(f"{self.path}/{found[-1][2]}") if found else self.spark.createDataFrame([], self.schema)

    def last_batch(self) -> int:
        """The number of the last batch that is in the store; -1 before any."""
        found = self.versions()
        return found[-1][1] if found else -1

    def upsert(self, new: DataFrame, batch: int | None = None, order: list[Column] = ()) -> bool:
        """Put rows in the place of those of their keys; False, and nothing changed, if the batch is in the store already.

        Of several new rows of a key the first by `order` stays (any, without one). Two writers at once: the second to
        rename fails, and its caller may try again on the new version.
        """
        found = self.versions()
        version, last = found[-1][:2] if found else (0, -1)
        if batch is not None and batch <= last:
            return False
        columns = self.rows().columns
        pick = Window.partitionBy(*self.keys).orderBy("__old", *order)
        both = self.rows().withColumn("__old", F.lit(1)).unionByName(new.select(*columns).withColumn("__old", F.lit(0)))
        merged = both.withColumn("__r", F.row_number().over(pick)).where("__r = 1").select(*columns)
        made = f"making-{uuid.uuid4().hex}"
        merged.write.parquet(f"{self.path}/{made}")
        if self.versions() != found or not self._fs.rename(self._at(made), self._at(f"version={version + 1:012d}-batch={last if batch is None else batch}")):
            self._fs.delete(self._at(made), True)
            raise RuntimeError("another writer was first")
        for _, _, old in self.versions()[: -self.keep]:
            self._fs.delete(self._at(old), True)
        return True

    def clear_unfinished(self) -> int:
        """Remove what killed writers left; how many there were. Only while no writer is at work."""
        left = [s.getPath() for s in self._fs.listStatus(self._at("")) if s.getPath().getName().startswith("making-")]
        for p in left:
            self._fs.delete(p, True)
        return len(left)

    def pending(self, work: DataFrame, again: Column | None = None) -> DataFrame:
        """Work whose key is not in the store, or whose stored row (columns of the store, as `stored`) meets `again`."""
        stored = self.rows().select(*self.keys, F.struct("*").alias("stored"))
        todo = F.col("stored").isNull()
        return work.join(stored, self.keys, "left").where(todo if again is None else todo | F.coalesce(again, F.lit(False))).drop("stored")

    def batches(self, step: Callable[[DataFrame], DataFrame], order: list[Column] = ()) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: step of each batch into the store, each batch once, also if the stream starts anew from its
        checkpoint after a crash between writing and committing."""

        def run(rows: DataFrame, batch: int) -> None:
            if batch > self.last_batch():
                self.upsert(step(rows), batch, order)

        return run
