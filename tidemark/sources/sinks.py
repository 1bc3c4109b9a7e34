"""Writers and idempotent ledgers."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import market


def append_new(ledger: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Ledger plus the new rows whose key it lacks; appending twice changes nothing."""
    once = new.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c) for c in new.columns if c != key][:1] or [key]))).where("__r = 1").drop("__r")
    return ledger.unionByName(once.join(ledger.select(key), key, "left_anti"), allowMissingColumns=True)


def settle(ledger: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Open rows (status OPEN, line, odds) get status and profit where results (key, margin) are known; others stay."""
    status = market.settled_status(F.col("__m"), F.col("line"), F.col("odds"))
    open_ = (F.col("status") == "OPEN") & F.col("__m").isNotNull()
    j = ledger.join(results.select(key, F.col("margin").alias("__m")), key, "left")
    return j.withColumn("profit", F.when(open_, market.handicap_profit(F.col("__m"), F.col("line"), F.col("odds"))).otherwise(F.col("profit"))).withColumn("status", F.when(open_, status).otherwise(F.col("status"))).drop("__m")


def performance(ledger: DataFrame) -> DataFrame:
    done = F.col("status").startswith("SETTLED")
    return ledger.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "OPEN").alias("open"), F.count_if(done).alias("settled"), F.sum(F.when(done, F.col("profit"))).alias("profit"), F.avg(F.when(done, (F.col("profit") > 0).cast("double"))).alias("win_rate"))


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV, JSON or Parquet by Spark's own writers; aggregates only, so one file."""
    w = df.coalesce(1).write.mode("overwrite")
    (w.option("header", True).csv if fmt == "csv" else getattr(w, fmt))(path)


def manifest(df: DataFrame, **facts: object) -> str:
    """A JSON manifest: columns, types, rows and given facts, keys sorted."""
    return json.dumps({"columns": dict(df.dtypes), "rows": df.count(), **facts}, sort_keys=True, default=str)


def html_table(df: DataFrame, title: str, most: int = 1000) -> str:
    """An HTML page of a small result; more than `most` rows is an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    body = "".join(f"<tr>{''.join(cell('td', v) for v in r)}</tr>" for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{''.join(cell('th', c) for c in df.columns)}</tr>{body}</table></body></html>"


def pending(work: DataFrame, done: DataFrame, key: str, again: Column | None = None) -> DataFrame:
    """Work that a resumed run still has to do: keys that are not done, and done ones for which `again` holds of the work."""
    seen = done.select(key).distinct().withColumn("__done", F.lit(True))
    left = work.join(seen, key, "left")
    todo = F.col("__done").isNull()
    return left.where(todo if again is None else todo | F.coalesce(again, F.lit(False))).drop("__done")


def safe_slug(x: Column) -> Column:
    """Lower-case letters and digits, everything else one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a small result; more than `most` rows is an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
