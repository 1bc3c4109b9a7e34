"""The ledger's query against its SQL."""

import duckdb

from tidemark.llm import queries

SF = "/root/testdata/sf0.01"


def test_ledger_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.op2_quality_rules(spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({queries.ORACLES['op2_quality_rules']})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(str, want))
