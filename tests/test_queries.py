import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return str(v)[:19] if hasattr(v, "isoformat") else v


LLM = [k for k in entry.queries() if k.startswith("op") or k in ("pipeline", "instruction_packing")]


def column(got, cols, name):
    return [r[cols.index(name)] for r in got]


#: Recursive, fuzzy and fitted queries have no SQL: what must hold of their rows; tests/test_without_sql.py has the rest.
WITHOUT_SQL = {
    "elo_ratings": lambda g, c: len(g) == len(set(column(g, c, "match_id"))) and all(0 < p < 1 for p in column(g, c, "p_home")),
    "dynamic_scoreline": lambda g, c: all(0.15 <= v <= 4.5 for n in ("rate_home", "rate_away") for v in column(g, c, n)) and min(column(g, c, "prior_matches")) == 0,
    "fuzzy_candidates": lambda g, c: all(s >= 0.78 for s in column(g, c, "score")) and max(column(g, c, "rank")) <= 3,
    "club_candidates": lambda g, c: len(g) > 0 and max(column(g, c, "rank")) <= 3 and all(s >= 0.68 or d or k for s, d, k in zip(*(column(g, c, n) for n in ("score", "direct", "contains")))),
    "ml_logistic": lambda g, c: len(g) > 0 and all(0 < p < 1 for p in column(g, c, "p")) and len(set(column(g, c, "p"))) > 10,
}


@pytest.mark.parametrize("name", [k for k in entry.queries() if k not in LLM])
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=str)
    sql = entry.oracle_sql().get(name)
    if not sql:
        assert name in WITHOUT_SQL and WITHOUT_SQL[name](got, cols)
    else:
        want = con.execute(f"select {', '.join(f'{c!r}'.replace(chr(39), chr(34)) for c in cols)} from ({sql})").fetchall()
        assert got == sorted((tuple(plain(v) for v in r) for r in want), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
