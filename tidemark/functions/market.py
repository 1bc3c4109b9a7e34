"""Odds and probability arithmetic as Columns. Invalid input gives NULL unless a function says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def plus(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def implied(odds: Column) -> Column:
    """1 / odds for odds above 1."""
    return F.when(odds > 1, 1 / odds)


def novig(odds: list[Column]) -> list[Column]:
    """Probabilities without the margin; all NULL if any leg is invalid."""
    raw = [implied(o) for o in odds]
    return [p / plus(raw) for p in raw]


def overround(odds: list[Column]) -> Column:
    return plus([implied(o) for o in odds]) - 1


def novig_skipping(odds: list[Column]) -> list[Column]:
    """As novig, but a missing leg counts 0 in the total and only its own probability is NULL."""
    raw = [implied(o) for o in odds]
    total = plus([F.coalesce(p, F.lit(0.0)) for p in raw])
    return [F.when(total > 0, p / total) for p in raw]


def two_way(p: Column, q: Column) -> list[Column]:
    return [F.when(p + q > 0, x / (p + q)) for x in (p, q)]


def logit(p: Column, eps: float = 1e-6) -> Column:
    c = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.when(p.isNotNull(), F.ln(c / (1 - c)))


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    e = [F.exp(s - top) for s in scores]
    return [x / plus(e) for x in e]


def normalise(ps: list[Column], eps: float = 1e-8) -> list[Column]:
    c = [F.greatest(F.least(p, F.lit(1.0)), F.lit(eps)) for p in ps]
    return [x / plus(c) for x in c]


def blend(market: list[Column], model: list[Column], alpha: Column, temperature: Column) -> list[Column]:
    """Logit-space blend of two distributions at a temperature; alpha 0 is the market."""
    lm, lx = ([F.ln(p) for p in normalise(ps)] for ps in (market, model))
    return softmax([((1 - alpha) * a + alpha * b) / temperature for a, b in zip(lm, lx)])


def blend_linear(market: Column, model: Column, alpha: Column) -> Column:
    return (1 - alpha) * market + alpha * model


def entropy(ps: list[Column]) -> Column:
    return -plus([F.when(p > 0, p * F.ln(p)).otherwise(F.when(p.isNotNull(), F.lit(0.0))) for p in ps])


def ev(p: Column, odds: Column) -> Column:
    return p * odds - 1


def fair_odds(p: Column) -> Column:
    return F.when(p > 0, 1 / p)


def clv(taken: Column, closing: Column) -> Column:
    return F.when(closing > 0, taken / closing - 1)


def gated_shift(line: Column, closing_line: Column, p: Column, closing_p: Column) -> Column:
    """Probability shift, only where both lines are the same."""
    return F.when(line == closing_line, closing_p - p)


def split_line(line: Column) -> list[Column]:
    """A quarter handicap as its two half lines; other lines twice themselves."""
    quarter = F.pmod(F.bround(line * 4).cast("long"), F.lit(2)) == 1
    return [F.when(quarter, F.floor(line * 2) / 2).otherwise(line), F.when(quarter, F.ceil(line * 2) / 2).otherwise(line)]


def handicap_parts(margin: Column, line: Column, odds: Column) -> list[Column]:
    """Unit profits of the two halves of a stake on the side with this goal margin and line."""
    return [F.when(margin + part > 0, odds - 1).when(margin + part < 0, F.lit(-1.0)).when((margin + part) == 0, F.lit(0.0)) for part in split_line(line)]


def handicap_profit(margin: Column, line: Column, odds: Column) -> Column:
    a, b = handicap_parts(margin, line, odds)
    return F.when(odds > 1, (a + b) / 2)


def handicap_label(margin: Column, line: Column, odds: Column) -> Column:
    a, b = handicap_parts(margin, line, odds)
    return (
        F.when(margin.isNull() | line.isNull() | odds.isNull() | ~(odds > 1), "invalid")
        .when((a > 0) & (b > 0), "full_win")
        .when((a < 0) & (b < 0), "full_loss")
        .when((a == 0) & (b == 0), "push")
        .when((a > 0) & (b == 0) | (a == 0) & (b > 0), "half_win")
        .when((a < 0) & (b == 0) | (a == 0) & (b < 0), "half_loss")
        .otherwise("impossible")
    )


def settled_status(margin: Column, line: Column, odds: Column) -> Column:
    """The label as a ledger status; what cannot be settled is blocked."""
    label = handicap_label(margin, line, odds)
    return F.when(label.isin("invalid", "impossible"), "BLOCKED_DATA_QUALITY").otherwise(F.concat(F.lit("SETTLED_"), F.upper(label)))


def settle_1x2(hit: Column, odds: Column) -> Column:
    return F.when(hit, odds - 1).otherwise(F.lit(-1.0))


def haircut(odds: Column, share: float) -> Column:
    """Odds less a share of their winnings' base, never under 1."""
    return F.greatest(odds * (1 - share), F.lit(1.0))


def double_chance(p1x: Column, p12: Column, px2: Column) -> list[Column]:
    """Home, draw and away probabilities that three double chances (normalised to sum 2) imply."""
    total = p1x + p12 + px2
    a, b, c = (2 * p / total for p in (p1x, p12, px2))
    return [(a + b - c) / 2, (a + c - b) / 2, (b + c - a) / 2]


def row_stats(cols: list[Column], ddof: int = 0) -> dict[str, Column]:
    """NaN- and NULL-skipping mean, std, max, min, range and count across columns of a row.

    Plain column sums, so that generated code shares them: no array, no lambda. `squares` is the sum of squared gaps from
    the mean, from which row_std makes another deviation.
    """
    values = [F.when(~F.isnan(c), c) for c in (c.cast("double") for c in cols)]
    n = plus([v.isNotNull().cast("int") for v in values])
    mean = F.when(n > 0, plus([F.coalesce(v, F.lit(0.0)) for v in values]) / n)
    squares = plus([F.coalesce((v - mean) * (v - mean), F.lit(0.0)) for v in values])
    top, low = (f(*values) if len(values) > 1 else values[0] for f in (F.greatest, F.least))
    out = {"mean": mean, "max": top, "min": low, "range": top - low, "count": n.cast("long"), "squares": squares}
    return out | {"std": row_std(out, ddof)}


def row_std(stats: dict[str, Column], ddof: int) -> Column:
    """Standard deviation with so many degrees of freedom less, from row_stats."""
    return F.when(stats["count"] > ddof, F.sqrt(stats["squares"] / (stats["count"] - ddof)))


def elo_expectation(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371.0088 km."""
    p1, p2, dp, dl = F.radians(lat1), F.radians(lat2), F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def cut(x: Column, edges: list[float], right: bool = True) -> Column:
    """Bucket label by edges: (a, b] or, with right False, [a, b); NULL outside."""
    out = None
    for a, b in zip(edges, edges[1:]):
        inside = (x > a) & (x <= b) if right else (x >= a) & (x < b)
        label = f"({a:g}, {b:g}]" if right else f"[{a:g}, {b:g})"
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def parse_money(text: Column) -> Column:
    """'€1.25m', '£300k', '$1,000' as a number."""
    clean = F.lower(F.regexp_replace(text, r"[€£$,\s]", ""))
    number = F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)?)(bn|m|k|th\.?)?$", 1)
    unit = F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)?)(bn|m|k|th\.?)?$", 2)
    return F.when(number != "", number.try_cast("double") * F.when(unit == "bn", 1e9).when(unit == "m", 1e6).when(unit.rlike("^(k|th)"), 1e3).otherwise(1.0))


def position_group(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike("keeper|^gk$"), "goalkeeper").when(t.rlike("back|defen|^(cb|lb|rb)$"), "defender").when(t.rlike("midfield|^(cm|dm|am)$"), "midfielder").when(t.rlike("wing|forward|striker|attack|^(st|cf|lw|rw)$"), "attacker").otherwise("unknown")


def poisson(k: Column, rate: Column) -> Column:
    return F.exp(-rate) * F.pow(rate, k) / F.factorial(k.cast("int"))


def low_score_factor(h: Column, a: Column, home: Column, away: Column, rho: float) -> Column:
    """Dixon-Coles correction of the four lowest scores, never negative; 1 elsewhere."""
    nought = F.lit(0.0)
    return (
        F.when((h == 0) & (a == 0), F.greatest(nought, 1 - home * away * rho))
        .when((h == 0) & (a == 1), F.greatest(nought, 1 + home * rho))
        .when((h == 1) & (a == 0), F.greatest(nought, 1 + away * rho))
        .when((h == 1) & (a == 1), F.greatest(nought, F.lit(1.0 - rho)))
        .otherwise(1.0)
    )


def handicap_units(margin: Column, line: Column) -> Column:
    """Settled units of one staked at even money: 1, 0.5, 0, -0.5 or -1 for the side with this margin and line."""
    return plus([F.signum(margin + part) for part in split_line(line)]) / 2


def favourite_flags(ps: list[Column]) -> dict[str, Column]:
    """Favourite's and underdog's probability, the favourite's place (first of equals) and flags of both outer places."""
    top = F.greatest(*ps)
    code = F.coalesce(*[F.when(p == top, F.lit(float(k))) for k, p in enumerate(ps)])
    return {"favourite_probability": top, "underdog_probability": F.least(*ps), "favourite_side_code": code, "home_is_favourite": (code == 0).cast("double"), "away_is_favourite": (code == len(ps) - 1).cast("double")}


def ordinal(x: Column, edges: list[float]) -> Column:
    """Place of the (a, b] bucket that holds x, from 0; NULL outside."""
    return F.coalesce(*[F.when((x > a) & (x <= b), F.lit(float(k))) for k, (a, b) in enumerate(zip(edges, edges[1:]))])


def one_hot(x: Column, values: list) -> dict[object, Column]:
    return {v: F.coalesce(x == v, F.lit(False)).cast("double") for v in values}


def era(year: Column, starts: tuple[int, ...] = (2012, 2017, 2020)) -> Column:
    """0 before the first start, then one more from each on."""
    return F.when(year.isNotNull(), plus([(year >= s).cast("double") for s in starts]))
