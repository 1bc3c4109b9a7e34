"""Every fixture has its score grid."""

import math

import pytest

import __spark_entry__ as entry
from tidemark.plans.base import fixtures

SF = "/root/testdata/sf0.001"


def test_every_fixture_has_its_grid(spark):
    got = {r.match_id: r for r in entry.queries()["score_grid_probs"](spark, SF).collect()}
    ids = [r.match_id for r in fixtures(spark, SF).select("match_id").collect()]
    assert len(ids) == len(got)
    for m in ids:
        lh, la = 0.5 + m % 20 / 10, 0.4 + m % 15 / 10
        p = {(i, j): math.exp(-lh) * lh**i / math.factorial(i) * math.exp(-la) * la**j / math.factorial(j) for i in range(11) for j in range(11)}
        share = lambda cond: sum(v for k, v in p.items() if cond(*k)) / sum(p.values())
        want = [share(lambda i, j: i > j), share(lambda i, j: i == j), share(lambda i, j: i + j > 2), share(lambda i, j: i > 0 and j > 0)]
        assert [got[m].p_home, got[m].p_draw, got[m].p_over25, got[m].p_btts] == pytest.approx(want, abs=2e-6)
