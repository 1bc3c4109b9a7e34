"""Cut points: tables written into the folder that all executors share, to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # by application


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without that setting has a temporary folder, a cluster without it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tidemark-cuts-")
        found = _own[app]
    return found.rstrip("/")


def cut(df: DataFrame, kind: str) -> DataFrame:
    """df written as Parquet and read back: what is lost later is read again, not computed again."""
    path = f"{shared_folder(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
