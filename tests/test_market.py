import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, market, text


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(("hg", "ag", "line", "odds", "label", "profit"), [
    (1, 0, 1.25, 2.0, "full_win", 1.0), (0, 1, 1.25, 2.0, "half_win", 0.5), (0, 1, 0.75, 2.0, "half_loss", -0.5), (1, 0, -1.0, 2.0, "push", 0.0),
    (1, 0, -0.75, 2.0, "half_win", 0.5), (0, 0, -0.25, 1.9, "half_loss", -0.5), (0, 2, 0.5, 1.9, "full_loss", -1.0), (1, 0, 0.5, 1.0, "invalid", None),
])
def test_handicap_settlement(spark, hg, ag, line, odds, label, profit):
    m, l, o = F.lit(hg - ag), F.lit(line), F.lit(odds)  # noqa: E741
    row = one(spark, market.handicap_label(m, l, o).alias("l"), market.handicap_profit(m, l, o).alias("p"), market.settled_status(m, l, o).alias("s"))
    assert row.l == label
    assert row.p == (None if profit is None else pytest.approx(profit))
    assert row.s == ("BLOCKED_DATA_QUALITY" if label == "invalid" else f"SETTLED_{label.upper()}")


def test_novig_and_clv(spark):
    row = one(spark, *[p.alias(f"p{i}") for i, p in enumerate(market.novig([F.lit(2.0), F.lit(4.0), F.lit(4.0)]))], market.clv(F.lit(2.2), F.lit(2.0)).alias("up"), market.clv(F.lit(1.8), F.lit(2.0)).alias("down"))
    assert (row.p0, row.p1, row.p2) == pytest.approx((0.5, 0.25, 0.25))
    assert (row.up, row.down) == pytest.approx((0.1, -0.1))


def test_novig_invalid_and_skipping(spark):
    bad = [F.lit(None).cast("double"), F.lit(4.0), F.lit(4.0)]
    strict = one(spark, *[p.alias(f"p{i}") for i, p in enumerate(market.novig(bad))])
    loose = one(spark, *[p.alias(f"p{i}") for i, p in enumerate(market.novig_skipping(bad))])
    assert list(strict) == [None] * 3
    assert loose.p0 is None and (loose.p1, loose.p2) == pytest.approx((0.5, 0.5))


def test_blend_alpha_zero_is_market(spark):
    ps = [F.lit(0.5), F.lit(0.3), F.lit(0.2)]
    row = one(spark, *[p.alias(f"p{i}") for i, p in enumerate(market.blend(ps, [F.lit(0.2), F.lit(0.2), F.lit(0.6)], F.lit(0.0), F.lit(1.0)))])
    assert list(row) == pytest.approx([0.5, 0.3, 0.2])


def test_elo_expectation_and_haircut(spark):
    row = one(spark, market.elo_expectation(F.lit(1560.0), F.lit(1500.0)).alias("e"), market.haircut(F.lit(1.01), 0.05).alias("h"))
    assert row.e == pytest.approx(1 / (1 + 10 ** (-60 / 400))) and row.h == 1.0


def test_money_and_position(spark):
    for raw, want in (("€1.25m", 1_250_000), ("£300k", 300_000), ("$1,000", 1000), ("free", None), (None, None)):
        assert one(spark, market.parse_money(F.lit(raw).cast("string")).alias("v")).v == (None if want is None else pytest.approx(want))
    assert one(spark, market.position_group(F.lit("Centre-Back")).alias("g")).g == "defender"


def test_cut_closedness(spark):
    row = one(spark, market.cut(F.lit(2.0), [1, 2, 3]).alias("r"), market.cut(F.lit(2.0), [1, 2, 3], right=False).alias("l"), market.cut(F.lit(9.0), [1, 2, 3]).alias("o"))
    assert (row.r, row.l, row.o) == ("(1, 2]", "[2, 3)", None)


@pytest.mark.parametrize(("raw", "want"), [("2025-08-15", "2025-08-15"), ("16/08/2025", "2025-08-16"), ("17-08-25", "2025-08-17"), ("bad", None), ("31/02/2025", None), (None, None)])
def test_mixed_dates(spark, raw, want):
    got = one(spark, dates.parse_mixed_date(F.lit(raw).cast("string")).alias("d")).d
    assert (str(got) if got else None) == want


def test_times_and_seasons(spark):
    d = F.lit("2025-08-15").cast("date")
    row = one(spark, dates.at_time(d, F.lit("20:00")).alias("a"), dates.at_time(d, F.lit(" ")).alias("b"), dates.season_label(d).alias("s"), dates.season_from_path(F.lit("/x/E0_2324.csv")).alias("p"), dates.path_date(F.lit("/s/2025/January/2/x.bz2")).alias("pd"))
    assert str(row.a) == "2025-08-15 20:00:00" and str(row.b) == "2025-08-15 00:00:00" and row.s == "2025/26" and row.p == 2023 and str(row.pd) == "2025-01-02"


def test_normalisers(spark):
    x = F.lit("Brighton & Hove Albion FC")
    row = one(spark, text.name_spaced(x).alias("a"), text.name_compact(x).alias("b"), text.name_slug(F.lit("Atlético Madrid")).alias("d"), text.token_sort(F.lit("b a")).alias("t"))
    assert row.a == "brighton and hove albion" and row.b == "brightonhovealbionfc" and row.d == "atletico_madrid" and row.t == "a b"


def test_row_stats_skip_nan(spark):
    s = market.row_stats([F.lit(1.0), F.lit(float("nan")), F.lit(None).cast("double"), F.lit(3.0)])
    row = one(spark, *[v.alias(k) for k, v in s.items()])
    assert row["mean"] == 2.0 and row["std"] == 1.0 and row["count"] == 2 and math.isclose(row["range"], 2.0)


def test_accents_are_those_of_the_decomposition(spark):
    import unicodedata

    names = ["Ångström", "Łódź", "Beşiktaş", "Çelik", "Ñandú", "e\u0301clair", "ﬁnal", "Ǆep", "Øster ßtadt", "Москва FC", "Ho\u0302\u0301t", "ăâîșț", "¹²³", None]
    got = [r.p for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(text.strip_accents(F.col("n")).alias("p")).collect()]
    assert got == [n and unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode() for n in names]
