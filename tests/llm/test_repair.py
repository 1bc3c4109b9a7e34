"""Repairs against their SQL and against every possible edit of short conversations."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from tidemark.llm import queries, repair

WELL = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """All edits of rows (role, text, fault), with up to two insertions at each place: (cost, audit, lines)."""
    best = None

    def go(k, cost, audit, roles, lines):
        nonlocal best
        if best and cost > best[0]:
            return
        if k == len(rows):
            for more in ((), ("user",), ("assistant",), ("user", "assistant")):
                if WELL.fullmatch(roles + "".join(m[0] for m in more)):
                    found = (cost + 3 * len(more), audit + "I" * len(more), (*lines, *(f"{m}:" for m in more)))
                    best = min(best or found, found)
            return
        role, text, fault = rows[k]
        for more in ((), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")):
            pre = (cost + 3 * len(more), audit + "I" * len(more), roles + "".join(m[0] for m in more), (*lines, *(f"{m}:" for m in more)))
            go(k + 1, pre[0] + 4, pre[1] + "D", pre[2], pre[3])
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault == "truncated" else 0
            go(k + 1, pre[0] + extra, pre[1] + "K", pre[2] + (role[:1] or "?"), (*pre[3], f"{role}:{text}"))
            for new in ("user", "assistant"):
                go(k + 1, pre[0] + 3 + extra, pre[1] + "R", pre[2] + new[0], (*pre[3], f"{new}:{text}"))

    go(0, 0, "", "", ())
    return best


def brute(rows):
    """rows: conv_id, turn, role, text; the whole contract, slowly."""
    out = {}
    for conv_id in dict.fromkeys(r[0] for r in rows):
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv_id):
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[0] for r in own if r[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        cost, audit, lines = cheapest([(r[1], r[2], f) for r, f in zip(own, faults)])
        out[conv_id] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_rows(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut off", "Why? \n", "", " \t", None, "Ça va.", "a. b", "Yes."])
            rows.append((conv, rng.choice([0, 1, 2, 3, 7, None, -4]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(3))
def test_equals_every_possible_edit(spark, seed):
    rows = odd_rows(seed)
    df = spark.createDataFrame([(*r, 1, True, "x") for r in rows], SCHEMA + ", cost int, there boolean, audit string").repartition(3)
    got = repair.repair(repair.damaged(df)).collect()
    want = brute(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id
    assert repair.repair(repair.damaged(df.limit(0))).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "odd"])
def test_query_equals_its_sql(spark, tmp_path, sf):
    folder = f"/root/testdata/{sf}"
    if sf == "odd":
        folder = str(tmp_path)
        spark.createDataFrame(odd_rows(9), SCHEMA).coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{folder}/conversations.parquet{'/*.parquet' if sf == 'odd' else ''}')")
    df = queries.op11_conversation_repair(spark, folder)
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.ORACLES['op11_conversation_repair']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_vectors_are_few_however_long_the_conversation():
    rng, costs = random.Random(1), repair.Costs()
    for _ in range(3000):
        costs.audit(bytes(rng.randrange(9) for _ in range(rng.randint(0, 60))))
    seen = len(costs.vectors)
    cost, audit = costs.audit(bytes(rng.randrange(9) for _ in range(200_000)))
    assert len(costs.vectors) <= seen + 5 < 200 and cost > 0 and len(audit) >= 200_000


def test_one_conversation_of_many_rows(spark):
    n = 30_000
    rows = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id, '.') as text", "true as there")
    r = repair.repair(rows).collect()
    lines = "\n".join(f"{'assistant' if i % 2 else 'user'}:t{i}." for i in range(n))
    assert len(r) == 1 and r[0].cost == 0 and r[0].audit == "K" * n and r[0].repaired_sha256 == hashlib.sha256(lines.encode()).hexdigest()
