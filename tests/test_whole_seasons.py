"""All seasons are returned."""

from collections import defaultdict

import pytest

import __spark_entry__ as entry
from tidemark.plans.base import fixtures, sides
from tidemark.plans.scalars import settled

SF = "/root/testdata/sf0.001"


def sides_of(spark):
    return sorted(sides(fixtures(spark, SF)).select("match_id", "team", "is_home", "match_date", "gf").collect(), key=lambda r: (r.match_date, r.match_id, r.is_home))


def test_every_side_has_its_sequence(spark):
    past, want = defaultdict(list), {}
    for r in sides_of(spark):
        seq = [g for d, g in past[r.team] if d < r.match_date][-5:]
        want[r.match_id, r.team, r.is_home] = (sum(seq), len(seq), 5 - len(seq))
        past[r.team].append((r.match_date, r.gf))
    got = entry.queries()["sequence_last5"](spark, SF).collect()
    assert {(r.match_id, r.team, r.is_home): (r.seq_sum, r.seq_len, r.pads) for r in got} == want and len(got) == len(want)


def test_every_side_has_its_shock(spark):
    rows, months = sides_of(spark), defaultdict(list)
    for r in rows:
        months[r.team, r.match_date.month].append(r.gf)
    mean = {k: sum(v) / len(v) for k, v in months.items()}
    want = {(r.match_id, r.team, r.is_home): r.gf - mean[r.team, r.match_date.month] for r in rows}
    got = entry.queries()["monthly_normal_shock"](spark, SF).collect()
    assert {(r.match_id, r.team, r.is_home): r.shock for r in got} == pytest.approx(want, abs=2e-6)


def test_every_month_is_summed(spark):
    want = defaultdict(lambda: [0, 0.0])
    for r in settled(fixtures(spark, SF)).select("match_date", "profit").collect():
        month = want[r.match_date.year, r.match_date.month]
        month[0] += 1
        month[1] += r.profit
    got = {(r.month.year, r.month.month): (r.bets, r.profit) for r in entry.queries()["month_summary"](spark, SF).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()}, abs=2e-6)
