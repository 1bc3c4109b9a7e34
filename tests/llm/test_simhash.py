"""The one-bit index: groups against all pairs, and the share of similar pairs that the cut finds."""

import random

import numpy as np
import pytest

from tidemark.llm import simhash


def test_one_bit_groups_hold_every_pair_within_a_bit(spark):
    rng = np.random.default_rng(1)
    values = {int(v) for v in rng.integers(0, 1 << 12, 300)}
    rows = [(part << 12 | v, 1000 * part + i, 0) for part in (0, 3) for i, v in enumerate(sorted(values))]
    rows += [(rows[5][0], 5000, 0), (rows[5][0], 5001, 0)]
    got = {}
    for r in simhash.one_bit_groups(spark.createDataFrame(rows, "k long, node long, check long"), 12).collect():
        got.setdefault(r.g, set()).add(r.node)
    together = {frozenset((x, y)) for g in got.values() for x in g for y in g if x < y}
    for k, x, _ in rows:
        for m, y, _ in rows:
            if x < y and k >> 12 == m >> 12 and (k ^ m).bit_count() <= 1:
                assert frozenset((x, y)) in together
    assert all(len(g) > 1 for g in got.values())


def test_a_value_that_most_rows_share_is_one_row(spark):
    rows = [(7, i, 0) for i in range(500)] + [(1 << 16 | i, i, 0) for i in range(0, 500, 3)]
    got = simhash.one_bit_groups(spark.createDataFrame(rows, "k long, node long, check long"), 16).where("g < 32").collect()
    assert sorted(r.node for r in got) == list(range(500)) and len({r.g for r in got}) == 1


@pytest.mark.parametrize("texts", [400, 220_000])
@pytest.mark.parametrize("size", [12, 40, 200])
def test_cut_finds_what_it_promises(texts, size):
    rng, cut = random.Random(3), simhash.Cut.of(texts, 0.8, 0.01)
    found = []
    for _ in range(600):
        a = np.array([rng.getrandbits(64) for _ in range(size)], np.uint64)
        b = a.copy()
        n = max(1, round(size * rng.uniform(0.06, 0.11)))
        b[:n] = [rng.getrandbits(64) for _ in range(n)]
        if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.8:
            continue
        differ = simhash.long_print(a, cut.lanes) != simhash.long_print(b, cut.lanes)
        segments = differ[: cut.width * cut.segments].reshape(cut.segments, cut.width).sum(1)
        found.append((segments <= 1).any() and differ[-64:].sum() <= cut.far(64, 4) and differ.sum() <= cut.far(64 * cut.lanes, 3))
    assert len(found) > 100 and np.mean(found) >= 0.97


def test_unrelated_sets_rarely_meet():
    rng, cut = np.random.default_rng(2), simhash.Cut.of(220_000, 0.8, 0.01)
    prints = np.stack([simhash.long_print(rng.integers(0, 1 << 63, 60).astype(np.uint64), cut.lanes) for _ in range(400)])
    gaps = [(prints[i] != prints[j]).sum() for i in range(400) for j in range(i)]
    assert min(gaps) > cut.far(64 * cut.lanes, 3)


def test_empty_and_one_shingle_sets():
    assert simhash.long_print(np.zeros(0, np.uint64), 3).sum() == 0
    assert 0 < simhash.long_print(np.array([12345], np.uint64), 3).sum() < 192
