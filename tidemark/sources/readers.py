"""Readers: tolerant CSV, compressed JSON lines, archives, SQLite, nested odds, inventories and request plans."""

from __future__ import annotations

import io
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import season_from_path
from ..functions.text import clean_header

# Encodings tried in turn.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin1")


def clean_columns(df: DataFrame) -> DataFrame:
    """Header without byte order marks and outer space; unnamed columns are dropped."""
    names = [clean_header(c) for c in df.columns]
    return df.toDF(*names).select(*[f"`{c}`" for c in names if c and not c.lower().startswith("unnamed") and not c.startswith("_c")])


def csv_strict(spark: SparkSession, path: str, schema: T.StructType | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Any malformed row fails the read."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("encoding", encoding)
    return clean_columns((reader.schema(schema) if schema else reader).csv(path))


def csv_flexible(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows that fit, and a one-row count of those that were skipped."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("columnPruning", False).csv(path)
    # a row is known to be malformed once all of its fields have been read
    read = F.xxhash64(*[f.name for f in schema.fields])
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt"), rows.agg(F.count(F.when(F.col("_corrupt").isNotNull(), read)).alias("skipped"))


def csv_resilient(spark: SparkSession, path: str) -> DataFrame:
    """Every row of ragged files, cut or filled to its own file's header, with malformed flagged, file and line kept.

    Whole small files are parsed one by one (mapInPandas), so files of other widths and encodings can lie side by side.
    Returns file, line, fields (map of header to value), malformed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for batch in batches:
            for path_, content in zip(batch["path"], batch["content"]):
                for enc in ENCODINGS:
                    try:
                        text = bytes(content).decode(enc)
                        break
                    except UnicodeDecodeError:
                        continue
                rows = list(csv.reader(io.StringIO(text)))
                if not rows:
                    continue
                head = [clean_header(c) for c in rows[0]]
                keep = [(i, c) for i, c in enumerate(head) if c and not c.lower().startswith("unnamed")]
                data = [r for r in rows[1:] if any(x.strip() for x in r)]
                yield pd.DataFrame({"file": path_, "line": range(2, len(data) + 2), "fields": [{c: (r[i] if i < len(r) else None) for i, c in keep} for r in data], "malformed": [len(r) != len(head) for r in data]})

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, "file string, line long, fields map<string,string>, malformed boolean")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, bz2 and gz included; an object that does not fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)


def zip_csv(spark: SparkSession, path: str, member: str = ".csv") -> DataFrame:
    """file, member, line_no, line: lines of the archives' members whose name ends with `member`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(member)):
                        lines = z.read(name).decode("utf-8-sig", "replace").splitlines()
                        yield pd.DataFrame({"file": p, "member": name, "line_no": range(1, len(lines) + 1), "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, member string, line_no long, line string")


def sqlite_inventory(spark: SparkSession, path: str) -> DataFrame:
    """file, table, column, type, n_rows of SQLite files, each read in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                with tempfile.NamedTemporaryFile(suffix=".db") as f:  # used and removed within the task
                    f.write(content)
                    f.flush()
                    con = sqlite3.connect(f.name)
                    rows = []
                    for (t,) in con.execute("select name from sqlite_master where type = 'table' order by 1").fetchall():
                        n = con.execute(f'select count(*) from "{t}"').fetchone()[0]
                        rows += [(p, t, c[1], c[2], n) for c in con.execute(f'pragma table_info("{t}")')]
                    con.close()
                yield pd.DataFrame(rows, columns=["file", "table", "column", "type", "n_rows"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, table string, column string, type string, n_rows long")


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """file, extension, bytes, sha256, season of the files under a path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select(F.col("path").alias("file"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), season_from_path(F.col("path")).alias("season"))


def daily_series(df: DataFrame, dates: str, values: list[str]) -> DataFrame:
    """Parallel arrays to rows; short arrays are filled with NULL."""
    other = [c for c in df.columns if c not in (dates, *values)]
    return df.select(*other, F.explode(F.arrays_zip(dates, *values)).alias("z")).select(*other, *[F.col(f"z.{c}").alias(c) for c in (dates, *values)])


ODDS = "array<struct<id:string,home_team:string,away_team:string,bookmakers:array<struct<key:string,markets:array<struct<key:string,outcomes:array<struct<name:string,price:double,point:double>>>>>>>>"


def spread_outcomes(df: DataFrame, payload: str) -> DataFrame:
    """Event, bookmaker and both sides of every spreads market that has both, from nested odds JSON."""
    e = df.select(F.explode(F.from_json(payload, ODDS)).alias("e")).select("e.*").withColumn("b", F.explode("bookmakers")).withColumn("m", F.explode("b.markets")).where("m.key = 'spreads'")
    side = lambda team: F.get(F.filter("m.outcomes", lambda x: x["name"] == F.col(team)), F.lit(0))
    e = e.withColumn("h", side("home_team")).withColumn("a", side("away_team")).where("h IS NOT NULL AND a IS NOT NULL")
    return e.select("id", F.col("b.key").alias("bookmaker"), "home_team", "away_team", F.col("h.point").alias("home_line"), F.col("h.price").alias("home_odds"), F.col("a.point").alias("away_line"), F.col("a.price").alias("away_odds"))


def request_plan(needs: DataFrame, cache: DataFrame, place: str, date: str) -> DataFrame:
    """Per place the range of dates that the cache lacks; each need counts once."""
    missing = needs.select(place, date).distinct().join(cache, [place, date], "left_anti")
    return missing.groupBy(place).agg(F.min(date).alias("from_date"), F.max(date).alias("to_date"), F.count(F.lit(1)).alias("n_dates"))


def first_messages(stream: DataFrame, key: str, order: list[str], n: int = 100) -> DataFrame:
    """The first n rows of each key by `order`, which should leave no ties.

    Each task keeps a counter and at most n rows a key while it reads, and only those travel: what a key has beyond its
    first n is dropped where it lies. A task holds at most n rows for each key in it.
    """
    at = stream.columns.index

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            both = rows if best is None else pa.concat_tables([best, rows])
            both = both.sort_by([(c, "ascending") for c in (key, *order)])
            codes = both.column(at(key)).combine_chunks().dictionary_encode()
            code = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(np.diff(code, prepend=code[:1] - 1)) if len(code) else np.zeros(0, int)
            place = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
            best = both.filter(pa.array(place < n))
        if best is not None:
            yield from best.to_batches()

    kept = stream.mapInArrow(head, stream.schema)
    first = Window.partitionBy(key).orderBy(*order)
    return kept.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= n).drop("__r")


# Bytes that Windows-1252 leaves open.
_OPEN_1252 = "(?i)^(..)*(81|8D|8F|90|9D)"


def encodings(spark: SparkSession, path: str) -> DataFrame:
    """file and encoding of the files under a path: the first of UTF-8 (a byte order mark is not part of the first
    line), Windows-1252 and Latin-1 in which every line is valid. Lines are looked at where they lie, so that a large file is
    many tasks' work."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    raw = F.hex(F.col("value").cast("binary"))
    found = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(raw.rlike(_OPEN_1252)).alias("open"))
    return found.select("file", F.when(F.col("utf8"), "utf-8").when(~F.col("open"), "cp1252").otherwise("latin1").alias("encoding"))


def csv_cascade(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV files of several encodings under one path, read strictly: any malformed row fails, none is skipped.

    Encodings are found first; then the files of each are one scan. schema: the columns by position.
    """
    by: dict[str, list[str]] = {}
    for r in encodings(spark, path).collect():  # a row a file, as any listing of inputs
        by.setdefault(r.encoding, []).append(r.file)
    # Windows-1252 is Latin-1 but for the letters in the place of control characters
    odd = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    odd = [(a, z) for a, z in odd if z]
    scans = []
    for encoding, files in sorted(by.items()):
        own = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", True).option("encoding", "UTF-8" if encoding == "utf-8" else "ISO-8859-1").csv(files)
        if encoding == "cp1252":
            own = own.withColumns({f.name: F.translate(f.name, "".join(a for a, _ in odd), "".join(z for _, z in odd)) for f in schema.fields if isinstance(f.dataType, T.StringType)})
        scans.append(own)
    if not scans:
        return spark.createDataFrame([], schema)
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out
