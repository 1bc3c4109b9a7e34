"""Identity, deduplication, conflicts, set algebra and alias resolution."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked


def flag_duplicates(df: DataFrame, keys: list[str], name: str = "is_duplicate") -> DataFrame:
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def conflict_status(df: DataFrame, keys: list[str], priority: str, variant: list[str]) -> DataFrame:
    """keys + n_rows, n_variants and status: none, resolved_by_source_priority, or quarantined if the top source itself disagrees.

    The status asks whether variants differ, which the smallest and the largest tell: one shuffle and one sort by the keys.
    n_variants is the only distinct count, made where it is asked for.
    """
    v = F.struct(*variant)
    topped = df.select(*keys, *[c for c in dict.fromkeys([priority, *variant]) if c not in keys], F.min(priority).over(Window.partitionBy(*keys)).alias("__top"))
    own = F.when(F.col(priority) == F.col("__top"), v)
    g = topped.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(v).alias("n_variants"), F.min(v).eqNullSafe(F.max(v)).alias("__same"), F.min(own).eqNullSafe(F.max(own)).alias("__t"))
    status = F.when(F.col("__same"), "none").when(F.col("__t"), "resolved_by_source_priority").otherwise("quarantined")
    return g.select(*keys, "n_rows", "n_variants", status.alias("status"))


def sequence_ids(df: DataFrame, keys: list[str], order: list[str], prefix: Column, width: int = 4) -> DataFrame:
    """Adds seq_id: prefix, then the row's place in its key, zero-padded."""
    return df.withColumn("seq_id", F.concat(prefix, F.lpad(F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("string"), width, "0")))


def upsert(history: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Union by name; for a key in both, current wins."""
    both = history.withColumn("__p", F.lit(1)).unionByName(current.withColumn("__p", F.lit(0)), allowMissingColumns=True)
    return keep_one(both, keys, [F.col("__p")]).drop("__p")


def combine(picks: DataFrame, keys: list[str], strategy: str, at_least: int) -> DataFrame:
    """Keys that at least so many strategies picked."""
    return picks.groupBy(*keys).agg(F.count_distinct(strategy).alias("n_strategies")).where(F.col("n_strategies") >= at_least)


def overlaps(picks: DataFrame, key: str, strategy: str) -> DataFrame:
    """Per pair of strategies: common keys and keys of one only. Counts by key and pair, no pair of rows."""
    own = picks.select(key, strategy).distinct()
    sizes = own.groupBy(strategy).agg(F.count(F.lit(1)).alias("n"))
    sets = own.groupBy(key).agg(F.sort_array(F.collect_set(strategy)).alias("s"))  # bounded by the number of strategies
    pairs = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    names = sizes.select(F.col(strategy).alias("a"), F.col("n").alias("na")).join(sizes.select(F.col(strategy).alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    return names.join(pairs, ["a", "b"], "left").select("a", "b", F.coalesce("both", F.lit(0)).alias("n_both"), (F.col("na") - F.coalesce("both", F.lit(0))).alias("only_a"), (F.col("nb") - F.coalesce("both", F.lit(0))).alias("only_b"))


def round_robin_sample(df: DataFrame, strata: list[str], order: list[str], n: int) -> DataFrame:
    """n rows, taken from the strata in turn."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))
    return ranked.orderBy("__r", *strata, *order).limit(n).drop("__r")


def alias_conflicts(aliases: DataFrame, alias: str, team: str) -> DataFrame:
    return aliases.groupBy(alias).agg(F.count_distinct(team).alias("n_teams"), F.array_join(F.sort_array(F.collect_set(F.col(team).cast("string"))), "; ").alias("teams")).where("n_teams > 1")


def surrogate_ids(known: DataFrame, names: DataFrame, name: str, id_col: str) -> DataFrame:
    """Known ids, and max + 1, + 2, .. for the missing names in sorted order, ranked by sorted ranges."""
    missing = names.select(name).distinct().join(known.select(name), name, "left_anti")
    top = known.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__m"))
    new = ranked(missing, [name], name="__r").crossJoin(F.broadcast(top)).select(name, (F.col("__m") + F.col("__r")).cast("long").alias(id_col))  # top is one row
    return known.select(name, F.col(id_col).cast("long").alias(id_col)).unionByName(new)


def alias_cascade(names: DataFrame, registry: DataFrame, curated: DataFrame, name: str, normal: Column, registry_normal: Column) -> DataFrame:
    """name, team and method: exact_normalised, curated or unmatched. Fuzzy candidates never resolve by themselves."""
    r = registry.select(registry_normal.alias("__n"), F.col("team").alias("t1")).groupBy("__n").agg(F.min("t1").alias("t1"), F.count_distinct("t1").alias("__k")).where("__k = 1").drop("__k")
    c = curated.groupBy(F.col("alias").alias("__a")).agg(F.min("team").alias("t2"))
    x = names.select(name).distinct().withColumn("__n", normal).join(r, "__n", "left").join(c, F.col(name) == F.col("__a"), "left")
    return x.select(name, F.coalesce("t1", "t2").alias("team"), F.when(F.col("t1").isNotNull(), "exact_normalised").when(F.col("t2").isNotNull(), "curated").otherwise("unmatched").alias("method"))


def _ratio(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from difflib import SequenceMatcher

    for b in batches:
        b["score"] = [round(max(SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, " ".join(sorted(x.split())), " ".join(sorted(y.split()))).ratio()), 4) for x, y in zip(b["name"], b["candidate"])]
        yield b


def close_pairs(names: DataFrame, registry: DataFrame, cutoff: float) -> DataFrame:
    """(a, b, block) of one block whose letters allow a Ratcliff-Obershelp ratio of cutoff or more: no such pair is missing.

    names: a, block; registry: b, block. The ratio is 2 m / (|a| + |b|) with m matched letters in order, so at a cutoff c
    |b| is within |a| c / (2 - c) and |a| (2 - c) / c, and at most d = (1 - c)(|a| + |b|) letters of both are unmatched. Each
    of them spoils at most one of d + 1 segments of a, so one stands whole in b; there is one, say the i-th, that is shifted
    by at most i from the front and d - i from the back. That is an equality join on length, segment and block; then the
    letters that both have, counted as multisets, bound m.
    """
    c, slack = cutoff, 1e-9
    d = lambda x, y: F.floor((1 - c) * (x + y) + slack).cast("int")
    left = names.select("a", "block", F.length("a").alias("la")).where("la > 0").distinct()
    low, high = F.ceil(F.col("la") * (c / (2 - c)) - slack).cast("int"), F.floor(F.col("la") * ((2 - c) / c) + slack).cast("int")
    left = left.select("a", "block", "la", F.explode(F.sequence(F.greatest(low, F.lit(1)), high)).alias("lb")).withColumn("n", d(F.col("la"), F.col("lb")) + 1)
    # segments of at most three letters' beginnings; with more segments than letters some are empty, and any b of the length may match
    place = lambda i: F.floor(i * F.col("la") / F.col("n")).cast("int")
    cut_ = lambda i: F.struct(i.alias("i"), place(i).alias("at"), F.substring("a", place(i) + 1, F.least(place(i + 1) - place(i), F.lit(3))).alias("seg"))
    left = left.select("a", "block", "la", "lb", (F.col("n") - 1).alias("d"), F.inline(F.transform(F.sequence(F.lit(0), F.col("n") - 1), cut_)))
    right = registry.select("b", "block", F.length("b").alias("lb")).where("lb > 0").distinct()
    here = lambda i: F.transform(F.sequence(F.lit(0), F.least(F.lit(3), F.col("lb") - i)), lambda k: F.struct(i.alias("to"), F.substring("b", i + 1, k).alias("seg")))
    right = right.select("b", "block", "lb", F.inline(F.flatten(F.transform(F.sequence(F.lit(0), F.col("lb") - 1), here))))
    met = left.join(right, ["block", "lb", "seg"]).where((F.abs(F.col("to") - F.col("at")) <= F.col("i")) & (F.abs(F.col("to") - F.col("at") - F.col("lb") + F.col("la")) <= F.col("d") - F.col("i")))
    met = met.select("a", "b", "block", "la", "lb").distinct()
    letters = lambda x: F.split(x, "")
    # letters with their number among equal ones, so that the sets' intersection is the multisets'
    marked = lambda x: F.aggregate(F.sort_array(letters(x)), F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"), F.lit(0).alias("k")), lambda s, y: F.struct(F.array_append(s["out"], F.concat(y, F.when(y == s["last"], s["k"] + 1).otherwise(0).cast("string"))).alias("out"), y.alias("last"), F.when(y == s["last"], s["k"] + 1).otherwise(0).alias("k")))["out"]
    shared = F.size(F.array_intersect(marked(F.col("a")), marked(F.col("b"))))
    return met.where(2 * shared >= c * (F.col("la") + F.col("lb")) - slack).select("a", "b", "block")


def fuzzy_candidates(names: DataFrame, registry: DataFrame, cutoff: float = 0.78, keep: int = 3, itself: bool = True) -> DataFrame:
    """(name, candidate, score, rank): review candidates of the same block; names and registry hold name and block.

    Ratcliff-Obershelp ratio to four places, the larger of plain and token-sorted; without itself, a name is no candidate of
    its own. Every pair of a block at the cutoff is found (close_pairs over names as they are and over their sorted tokens); only
    pairs that the letters allow are scored.
    """
    tokens = lambda x: F.array_join(F.sort_array(F.filter(F.split(x, r"\s+"), lambda t: t != "")), " ")
    found = None
    for form in (lambda x: x, tokens):
        a = names.select(F.col("name"), form(F.col("name")).alias("a"), "block").distinct()
        b = registry.select(F.col("name").alias("candidate"), form(F.col("name")).alias("b"), "block").distinct()
        own = close_pairs(a, b, cutoff - 0.00005).join(a, ["a", "block"]).join(b, ["b", "block"]).select("name", "candidate")
        found = own if found is None else found.unionByName(own)
    pairs = found.distinct()
    pairs = pairs if itself else pairs.where("name <> candidate")
    scored = pairs.mapInPandas(_ratio, "name string, candidate string, score double").where(F.col("score") >= cutoff)
    w = Window.partitionBy("name").orderBy(F.desc("score"), "candidate")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


# What the parts of a club candidate's score add, and the least score of one that no alias speaks for.
SAME_COMPETITION, DIRECT_ALIAS, NAME_TOKEN, LEAST_SCORE = 0.12, 0.18, 0.06, 0.68


def composite_candidates(teams: DataFrame, clubs: DataFrame, forms: list[Callable[[Column], Column]], top: int = 8) -> DataFrame:
    """team, club, same_competition, direct, contains, similarity, score, rank: at most `top` clubs for each team.

    teams: team, competition; clubs: club, competition. forms: spellings of a name, the first with spaces between its words
    and the last with club words dropped. similarity is the largest ratio of the same form of both (an empty form is like nothing); direct: some form of
    one is some form of the other; contains: the team's first or last form is a word of the club's first. Those without
    either need a score of LEAST_SCORE. Own competition first, then by score, then by name.

    A pair can only count if a form is alike enough for the score (close_pairs, which loses none), a form is shared, or a
    word: three joins on equal values, of which the union is scored.
    """
    t = teams.select("team", "competition", *[f(F.col("team")).alias(f"f{i}") for i, f in enumerate(forms)]).distinct()
    c = clubs.select("club", F.col("competition").alias("own"), *[f(F.col("club")).alias(f"g{i}") for i, f in enumerate(forms)]).distinct()
    n, last = len(forms), len(forms) - 1
    spelt = lambda side: F.array_distinct(F.filter(F.array(*[F.col(f"{side}{i}") for i in range(n)]), lambda x: x != ""))
    words = F.filter(F.split("g0", " "), lambda x: x != "")
    parts = [
        t.select("team", F.explode(spelt("f")).alias("x")).join(c.select("club", F.explode(spelt("g")).alias("x")), "x").select("team", "club"),
        t.select("team", F.explode(F.array_distinct(F.array("f0", f"f{last}"))).alias("x")).join(c.select("club", F.explode(words).alias("x")), "x").select("team", "club"),
    ]
    for i in range(n):
        a, b = t.select("team", F.col(f"f{i}").alias("a"), F.lit("").alias("block")), c.select("club", F.col(f"g{i}").alias("b"), F.lit("").alias("block"))
        met = close_pairs(a, b, LEAST_SCORE - SAME_COMPETITION - 0.00005).drop("block")
        parts.append(met.join(a, "a").join(b, "b").select("team", "club"))
    pairs = functools.reduce(DataFrame.unionByName, parts).distinct().join(t, "team").join(c, "club")
    direct = F.arrays_overlap(spelt("f"), spelt("g"))
    contains = F.coalesce((F.col("f0") != "") & F.array_contains(words, F.col("f0")), F.lit(False)) | F.coalesce((F.col(f"f{last}") != "") & F.array_contains(words, F.col(f"f{last}")), F.lit(False))

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for b in batches:
            yield b[["team", "club", "same_competition", "direct", "contains"]].assign(similarity=[max(SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in ((getattr(r, f"f{i}"), getattr(r, f"g{i}")) for i in range(n))) for r in b.itertuples()])

    flagged = pairs.withColumn("same_competition", F.coalesce(F.col("own") == F.col("competition"), F.lit(False))).withColumn("direct", direct).withColumn("contains", contains)
    alike = flagged.mapInPandas(ratios, "team string, club string, same_competition boolean, direct boolean, contains boolean, similarity double")
    bonus = lambda flag, x: F.when(F.col(flag), x).otherwise(0.0)
    scored = alike.withColumn("score", F.round(F.col("similarity") + bonus("same_competition", SAME_COMPETITION) + bonus("direct", DIRECT_ALIAS) + bonus("contains", NAME_TOKEN), 4)).withColumn("similarity", F.round("similarity", 4))
    w = Window.partitionBy("team").orderBy(F.desc("same_competition"), F.desc("score"), "club")
    return scored.where(F.col("direct") | F.col("contains") | (F.col("score") >= LEAST_SCORE)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def best_with_margin(scored: DataFrame, least: float = 0.80, margin: float = 0.04) -> DataFrame:
    """The top candidate of a name, if good enough and clear of the second."""
    w = Window.partitionBy("name").orderBy(F.desc("score"), "candidate")
    ranked = scored.withColumn("__r", F.row_number().over(w)).withColumn("second", F.lead("score").over(w))
    return ranked.where((F.col("__r") == 1) & (F.col("score") >= least) & (F.col("score") - F.coalesce("second", F.lit(0.0)) >= margin)).drop("__r")


class DecisionError(ValueError):
    """A decision names an alias that is not there once, or not as it says."""


def apply_decisions(aliases: DataFrame, decisions: DataFrame) -> DataFrame:
    """aliases with alias_status and approved set where decisions (alias_id, alias_name, team_id, decision) say so.

    Every decision must meet exactly one alias of that id, name and team, else DecisionError (one action over decisions).
    """
    d = decisions.select("alias_id", F.col("alias_name").alias("__n"), F.col("team_id").alias("__t"), F.col("decision").alias("__d"))
    joined = aliases.join(d, "alias_id", "left")
    found = d.join(aliases.select("alias_id", "alias_name", "team_id"), "alias_id", "left").groupBy("alias_id").agg(F.count_if((F.col("alias_name") == F.col("__n")) & (F.col("team_id") == F.col("__t"))).alias("ok"), F.count(F.lit(1)).alias("n"))
    if found.where("ok <> 1 OR n <> 1").limit(1).count():
        raise DecisionError("a decision does not meet exactly one alias")
    status = F.when(F.col("__d") == "approved", "approved_obvious_alias").when(F.col("__d") == "rejected", "rejected").otherwise(F.col("alias_status"))
    return joined.select(*[c for c in aliases.columns if c not in ("alias_status", "approved")], status.alias("alias_status"), F.coalesce(F.col("__d") == "approved", F.col("approved")).alias("approved"))


def split_event(name: Column) -> Column:
    """The two parties of an event name, split at v, vs, @ or a dash between spaces; NULL unless there are two."""
    parts = F.split(name, r"(?i)\s+(?:v|vs|@)\s+|\s+-\s+")
    return F.when(F.size(parts) == 2, parts)


def orientation(names: Column, ids: Column, home: Column, away: Column) -> Column:
    """(home, away, draw) runner ids by name, whatever the runners' order; NULL unless each is there exactly once."""
    pairs = F.arrays_zip(names.alias("n"), ids.alias("i"))
    own = lambda want: F.filter(pairs, lambda p: p["n"] == want)
    drawn = F.filter(pairs, lambda p: p["n"].isin("draw", "the draw"))
    h, a = own(home), own(away)
    return F.when((F.size(h) == 1) & (F.size(a) == 1) & (F.size(drawn) == 1), F.struct(h[0]["i"].alias("home"), a[0]["i"].alias("away"), drawn[0]["i"].alias("draw")))


def mapping_status(approved: Column, n_eligible: Column, candidate_alias: Column, n_near: Column, n_far: Column, duplicate: Column, market_type: Column, runners: Column, draws: Column, status: Column, any_team: Column) -> Column:
    """Why a fixture is or is not mapped to a market: the first condition that holds, in this order.

    The statuses and their order are fixed values of the audit's format.
    """
    return (
        F.when(approved, "mapped_approved")
        .when((n_eligible == 1) & candidate_alias, "team_alias_unresolved")
        .when(n_eligible > 1, "multiple_candidate_markets")
        .when((n_far > 0) & (n_near == 0), "date_mismatch")
        .when((n_near > 0) & duplicate, "duplicate_market")
        .when((n_near > 0) & (market_type != "MATCH_ODDS"), "non_match_odds")
        .when((n_near > 0) & ((runners != 3) | (draws != 1)), "incomplete_runners")
        .when((n_near > 0) & (status != "OPEN"), "market_cancelled_or_invalid")
        .when(n_near > 0, "home_away_orientation_unresolved")
        .when(any_team, "team_alias_unresolved")
        .otherwise("no_betfair_candidate")
    )


def candidate_decisions(candidates: DataFrame, keys: list[str], support: DataFrame) -> DataFrame:
    """keys, candidate, score, competing, support, seasons and decision of each key's best candidate.

    candidates: keys (league, season, team), candidate, score, exact (boolean), same_competition (boolean); support: keys,
    candidate, n (fixtures that speak for it). A candidate that is best in two seasons of a team is stable. Approved
    candidates that two teams of a season share go back to review. The bounds (0.80, 0.86, 0.72, 0.68, a gap of 0.05 for
    competing and of 0.04 for clear candidates, 2 and 3 fixtures of support, 3 signals) and the decisions are fixed values.
    """
    league, season, team = keys
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "candidate")
    top = candidates.withColumn("__r", F.row_number().over(w)).withColumn("__second", F.lead("score").over(w)).withColumn("__top", F.max("score").over(Window.partitionBy(*keys)))
    close = F.count_if(F.col("score") >= F.greatest(F.lit(0.80), F.col("__top") - 0.05)) - 1
    near = top.groupBy(*keys).agg(close.alias("competing"))
    best = top.where("__r = 1").join(near, keys).join(support.withColumnRenamed("n", "support"), [*keys, "candidate"], "left").withColumn("support", F.coalesce("support", F.lit(0)))
    stable = best.groupBy(league, team, "candidate").agg(F.count_distinct(season).alias("seasons"))
    best = best.join(stable, [league, team, "candidate"])
    high = F.col("score") >= 0.86
    signals = F.col("same_competition").cast("int") + F.col("exact").cast("int") + high.cast("int") + (F.col("support") >= 2).cast("int") + ((F.col("competing") == 0) & (F.col("score") - F.coalesce("__second", F.lit(0.0)) >= 0.04)).cast("int") + (F.col("seasons") >= 2).cast("int")
    decision = (
        F.when(~F.col("same_competition"), "rejected_wrong_country_or_competition")
        .when(F.col("exact") & (F.col("competing") == 0), "approved_exact")
        .when((F.col("competing") > 0) & (F.col("support") < 2), "rejected_ambiguous")
        .when((F.col("score") < 0.68) & (F.col("support") < 2), "rejected_low_similarity")
        .when(high & (signals >= 3) & (F.col("competing") == 0) | (F.col("support") >= 3) & (F.col("score") >= 0.72) & (F.col("competing") == 0), "approved_high_confidence_alias")
        .otherwise("manual_review_required")
    )
    best = best.withColumn("decision", decision)
    ok = F.col("decision").isin("approved_exact", "approved_high_confidence_alias")
    shared = F.count_if(ok).over(Window.partitionBy(league, season, "candidate")) > 1
    return best.select(*keys, "candidate", "score", "competing", "support", "seasons", F.when(ok & shared, "manual_review_required").otherwise(F.col("decision")).alias("decision"))


def loose_duplicates(df: DataFrame, name: str, keys: list[str], date: str) -> DataFrame:
    """duplicate_key_type, keys, rows, unique_dates of keys with more than one row (NULL is a key too)."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(date).alias("unique_dates")).where("rows > 1")
    return g.select(F.lit(name).alias("duplicate_key_type"), *keys, "rows", "unique_dates")


def quantile_sample(values: DataFrame, order: str, blocks: int, places: int) -> DataFrame:
    """block, place and value: of each of `blocks` equal runs of the distinct values in order, `places` evenly spaced ones.

    values: one row per distinct value, such as the dates of an archive. Earlier blocks take the rows left over; places
    are rounded down.
    """
    placed = ranked(values.select(order), [order], name="__r").select(order, (F.col("__r") - 1).alias("__i"))
    n = values.agg(F.count(F.lit(1)).alias("__n"))
    k, j = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("j")
    plan = n.select("__n", k).select("__n", "k", j)
    base, extra = F.floor(F.col("__n") / blocks), F.col("__n") % blocks
    low = F.col("k") * base + F.least(F.col("k"), extra)
    size = base + (F.col("k") < extra).cast("long")
    plan = plan.select((F.col("k") + 1).alias("third"), (F.col("j") + 1).alias("place"), (low + F.floor((size - 1) * F.col("j") / (places - 1))).alias("__i"))
    return placed.join(F.broadcast(plan), "__i").select("third", "place", order)  # blocks x places rows
