"""Composite candidates against every pair scored in plain Python."""

from difflib import SequenceMatcher

from tidemark.functions import text
from tidemark.operators import identity


def test_no_candidate_is_overlooked(spark):
    teams = [("Inter Milan", "IT"), ("Man United", "EN"), ("St Pauli", "DE"), ("Real Sociedad", "ES"), ("AC", "IT"), ("Köln", "DE"), ("", "DE"), ("Paris", None)]
    clubs = [("FC Internazionale Milano", "IT"), ("AC Milan", "IT"), ("Manchester United FC", "EN"), ("Man United", "EN"), ("FC St. Pauli", "DE"), ("Real Sociedad de Fútbol", "ES"), ("Real Madrid", "ES"), ("1. FC Koln", "DE"), ("Paris FC", "FR"), ("", "FR"), ("Pauli", "AT")]
    forms = [text.name_player, text.name_compact, text.name_spaced]
    t, c = spark.createDataFrame(teams, "team string, competition string"), spark.createDataFrame(clubs, "club string, competition string")
    spell = lambda df, col: {r[0]: tuple(r)[1:] for r in df.select(col, *[f(df[col]).alias(f"x{i}") for i, f in enumerate(forms)]).collect()}
    a, b = spell(t, "team"), spell(c, "club")
    want = {}
    for team, league in teams:
        rows = []
        for club, own in clubs:
            x, y = a[team], b[club]
            direct = bool(({*x} - {""}) & ({*y} - {""}))
            contains = any(v and v in y[0].split() for v in (x[0], x[2]))
            alike = max(SequenceMatcher(None, p, q).ratio() if p and q else 0.0 for p, q in zip(x, y))
            score = round(alike + 0.12 * (league is not None and own == league) + 0.18 * direct + 0.06 * contains, 4)
            if direct or contains or score >= 0.68:
                rows.append((league is not None and own == league, score, club))
        for k, (same, score, club) in enumerate(sorted(rows, key=lambda r: (not r[0], -r[1], r[2]))[:4], 1):
            want[team, k] = (club, same, score)
    got = {(r.team, r.rank): (r.club, r.same_competition, r.score) for r in identity.composite_candidates(t, c, forms, 4).collect()}
    assert got == want and len(want) > 10
