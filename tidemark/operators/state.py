"""Recursive state across rows: ratings and decayed score rates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _scan(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """Rows of each key in order (nulls last) through step(state, batch); a key's state comes from start().

    Spark sorts; a worker holds one batch and the state of one key, never a key's rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for pdf in batches:
            for own, part in pdf.groupby(key, sort=False, dropna=False):
                now = (None if pd.isna(own) else own,)
                if now != at:
                    at, held = now, start()
                out = step(held, part)
                if len(out):
                    yield out

    by = [key, *order]
    return rows.repartition(key).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in by]).mapInPandas(run, schema)


def elo(matches: DataFrame, league: str = "league", start: float = 1500.0, k: float = 20.0, advantage: float = 60.0) -> DataFrame:
    """Ratings before each match, updated after it, per league: match_id, home_elo_pre, away_elo_pre, p_home.

    Matches in order of date and match_id. A missing score changes nothing; a missing team gets no row. State crosses
    teams, so a league is one ordered scan; leagues run in parallel.
    """

    def step(rating: dict[int, float], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["home"].notna() & pdf["away"].notna()]
        known, out = (pdf["hg"].notna() & pdf["ag"].notna()).tolist(), []
        for m, played in zip(pdf.itertuples(), known):
            h, a = rating.get(m.home, start), rating.get(m.away, start)
            p = 1 / (1 + 10 ** ((a - h - advantage) / 400))
            out.append((m.match_id, h, a, p))
            if played:
                s = 1.0 if m.hg > m.ag else 0.5 if m.hg == m.ag else 0.0
                rating[m.home], rating[m.away] = h + k * (s - p), a - k * (s - p)
        return pd.DataFrame(out, columns=["match_id", "home_elo_pre", "away_elo_pre", "p_home"])

    rows = matches.select(league, "match_id", "match_date", "home", "away", "hg", "ag")
    return _scan(rows, league, ["match_date", "match_id"], dict, step, "match_id long, home_elo_pre double, away_elo_pre double, p_home double")


# Name, decay a year, weight of the prior and low-score correction of the candidates, and the prior's goals.
CANDIDATES = (("poisson_decay_0_5_prior_10", 0.5, 10.0, 0.0), ("poisson_decay_1_0_prior_10", 1.0, 10.0, 0.0), ("dc_decay_0_5_prior_10", 0.5, 10.0, -0.05), ("dc_decay_1_0_prior_20", 1.0, 20.0, -0.05))
PRIOR_HOME, PRIOR_AWAY = 1.35, 1.10


def scoreline(matches: DataFrame, league: str = "league", candidates: tuple = CANDIDATES, low: float = 0.15, high: float = 4.5) -> DataFrame:
    """Expected goals before each match, from exponentially decayed team sums shrunk to the league's running means.

    match_id, candidate, rho, prior_matches (fewer of the two teams'), rate_home, rate_away, uncertainty, home_staleness and
    away_staleness (days since a team's last match, NULL before its first). Predict, then update; a missing score updates
    nothing. State crosses the teams of a league, so a league is one ordered scan, which carries all candidates along; leagues
    run side by side.
    """

    def start() -> list:
        return [[{}, [0.0, 0.0], 0] for _ in candidates]  # teams: goals for, against, weight, last day, matches; goals and matches of all

    def step(held: list, pdf: pd.DataFrame) -> pd.DataFrame:
        known, days, out = (pdf["hg"].notna() & pdf["ag"].notna()).tolist(), [pd.Timestamp(d).toordinal() for d in pdf["match_date"]], []
        for m, played, day in zip(pdf.itertuples(), known, days):
            for own, (name, decay, prior, rho) in zip(held, candidates):
                team, sums, n = own
                now = []
                for t in (m.home, m.away):
                    f, a, w, last, k = team.get(t, (0.0, 0.0, 0.0, None, 0))
                    keep = 1.0 if last is None else math.exp(-decay * max(0, day - last) / 365.25)
                    now.append((f * keep, a * keep, w * keep, last, k))
                base = [(s + p * prior) / (n + prior) for s, p in zip(sums, (PRIOR_HOME, PRIOR_AWAY))]
                (hf, ha, hw, hl, hk), (af, aa, aw, al, ak) = now
                attack = (hf + base[0] * prior) / (hw + prior), (af + base[1] * prior) / (aw + prior)
                defence = (ha + base[1] * prior) / (hw + prior), (aa + base[0] * prior) / (aw + prior)
                rates = [min(max(attack[i] * defence[1 - i] / max(base[i], 0.2), low), high) for i in (0, 1)]
                stale = [None if last is None else day - last for last in (hl, al)]
                out.append((m.match_id, name, rho, min(hk, ak), *rates, 1 / math.sqrt(hw + 1) + 1 / math.sqrt(aw + 1), *stale))
                if played:
                    for t, was, f, a in ((m.home, now[0], m.hg, m.ag), (m.away, now[1], m.ag, m.hg)):
                        team[t] = (was[0] + f, was[1] + a, was[2] + 1, day, was[4] + 1)
                    own[1], own[2] = [sums[0] + m.hg, sums[1] + m.ag], n + 1
        return pd.DataFrame(out, columns=["match_id", "candidate", "rho", "prior_matches", "rate_home", "rate_away", "uncertainty", "home_staleness", "away_staleness"]).astype({"home_staleness": "Int64", "away_staleness": "Int64"})

    rows = matches.select(league, "match_id", "match_date", "home", "away", "hg", "ag")
    return _scan(rows, league, ["match_date", "home", "away", "match_id"], start, step, "match_id long, candidate string, rho double, prior_matches long, rate_home double, rate_away double, uncertainty double, home_staleness long, away_staleness long")
