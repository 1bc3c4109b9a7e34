"""Cheapest repairs of conversations, by a weighted automaton that is made deterministic as it is used.

A conversation's rows are symbols (role and fault), its well-formed role orders an automaton of four states. The cost of
repairing the rest of a conversation, for each state that one may be in, is a vector; less its least entry it is one of
few vectors, however long conversations are. Those are the states of a deterministic automaton whose transitions are
kept in a table, entered when first met: after that a conversation is a walk through the table from its last row to
its first, a lookup a row. The trace goes the other way: from the first row on it takes the first edit in ASCII order
among those that the vectors show to be tight, which is the least audit of all cheapest ones.

Rows of a conversation are sorted in its task and stream through it. What is held of a conversation is four bytes a row in
the scan and its audit, a byte a row, when the text is hashed: never its texts. An audit and a hash are chains, so a
conversation is one task's work.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: States: nothing yet, after s, after u, after a. The initial that may come in a state besides s at first, and the state
#: after it.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
NAME = {"u": "user", "a": "assistant"}
FINAL = (START, ASSISTANT)

#: Symbols: a row's initial (s, u, a or another) with 4 added where it is truncated; GONE where it must be deleted.
INITIALS = "sua"
OTHER, GONE = 3, 8

_FAR = 1 << 40


class Costs:
    """The deterministic automaton, from the end of a conversation to its start."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: list[list[tuple[int, int] | None]] = []
        self.end = self._add(self._closed([0 if q in FINAL else _FAR for q in range(4)]))

    def _add(self, costs: list[int]) -> tuple[int, int]:
        """(number, least): the vector less its least entry."""
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * (GONE + 1))
        return self.number[vector], least

    @staticmethod
    def _closed(costs: list[int]) -> list[int]:
        """With insertions before the next row."""
        for _ in range(3):
            costs = [min(costs[q], INSERT + costs[NEXT[q][1]]) for q in range(4)]
        return costs

    @staticmethod
    def arcs(state: int, symbol: int) -> Iterator[tuple[str, int, int]]:
        """(edit, cost, next state) of a row, in ASCII order of the edits: D, K, R."""
        yield "D", DELETE, state
        if symbol != GONE:
            initial, extra = symbol % 4, TRUNCATED * (symbol // 4)
            wants, after = NEXT[state]
            if initial == 0 and state == START:
                yield "K", extra, SYSTEM
            elif initial != OTHER and INITIALS[initial] == wants:
                yield "K", extra, after
            yield "R", REROLE + extra, after

    def step(self, vector: int, symbol: int) -> tuple[int, int]:
        """The vector before a row, and what the least entry grows by."""
        found = self.table[vector][symbol]
        if found is None:
            after = self.vectors[vector]
            found = self.table[vector][symbol] = self._add(self._closed([min(cost + after[q] for _, cost, q in self.arcs(state, symbol)) for state in range(4)]))
        return found

    def audit(self, symbols: bytes) -> tuple[int, str]:
        """(cost, audit) of a conversation's rows."""
        vector, cost = self.end
        walk, grown = array("i", [vector]), array("q", [cost])
        for s in reversed(symbols):
            vector, more = self.step(vector, s)
            walk.append(vector)
            grown.append(more)
            cost += more
        total = cost + self.vectors[vector][START]
        # back along tight arcs: cost[k] of the rows from k on is vectors[walk[k]] + the growth up to there
        state, out, k = START, bytearray(), len(symbols)
        while True:
            now = self.vectors[walk[k]]
            if k:
                here, after = now[state] + grown[k], self.vectors[walk[k - 1]]
                own = list(self.arcs(state, symbols[len(symbols) - k]))
                tight = {edit: q for edit, c, q in own if c + after[q] == here}
            elif state in FINAL and now[state] == 0:
                break
            else:
                tight = {}
            inserted = INSERT + now[NEXT[state][1]] == now[state]
            edit = "D" if "D" in tight else "I" if inserted else "K" if "K" in tight else "R"
            out += edit.encode()
            if edit == "I":
                state = NEXT[state][1]
            else:
                state, k = tight[edit], k - 1
        return total, out.decode()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there: rows after damage by crc32(`conv_id:turn`) % 20.

    Nulls are one space; 0 drops a row (it stays as one that is not there, for its conversation's sake), 1 empties its
    text, 2 removes the stops from it, 3 repeats it, 4 makes it the user's.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).when(kind > 0, spaced("text"))
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (kind > 0).alias("there"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")


def initial_code(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(OTHER)


BLANK, DUPLICATE, CUT = 1, 2, 3


def faults(rows: DataFrame) -> DataFrame:
    """rows with code (the role's initial), again (role and text are there earlier) and fault: 0, BLANK, DUPLICATE or CUT, the
    first that holds."""
    before = F.row_number().over(Window.partitionBy("conv_id", "there", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(WORD), BLANK).when(F.col("again"), DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(0)
    return rows.withColumn("code", initial_code(F.col("role"))).withColumn("again", before).withColumn("fault", F.when(F.col("there"), fault).otherwise(-1))


REPAIR = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn to a row a conversation."""
    costs, legal = Costs(), {(0, 1), (1, 2), (2, 1)}
    now, symbols, counts, turns, illegal, last = None, bytearray(), [0, 0, 0, 0], (None, None, 0), 0, None
    out: list[tuple] = []

    def closed() -> tuple:
        cost, audit = costs.audit(bytes(symbols))
        low, high, n = turns
        return now[0], 0 if low is None else high - low + 1 - n, *counts[1:], illegal, cost, audit

    def batch() -> pa.RecordBatch:
        kinds = [*[pa.int64()] * 7, pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], names=[c.split()[0] for c in REPAIR.split(", ")])
        out.clear()
        return made

    for rows in batches:
        for conv_id, turn, code, fault in zip(*(rows.column(k).to_pylist() for k in range(4))):
            if now is None or conv_id != now[0]:
                if now is not None:
                    out.append(closed())
                now, symbols, counts, turns, illegal, last = (conv_id,), bytearray(), [0, 0, 0, 0], (None, None, 0), 0, None
            if fault < 0:
                continue
            counts[fault] += 1
            symbols.append(GONE if fault in (BLANK, DUPLICATE) else code + 4 * (fault == CUT))
            if turn is not None and turn != turns[1]:
                turns = (turn if turns[0] is None else turns[0], turn, turns[2] + 1)
            illegal += last is not None and (last, code) not in legal
            last = code
        yield batch()
    if now is not None:
        out.append(closed())
        yield batch()


REPAIRED = f"{REPAIR}, repaired_sha256 string"


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's repair and then its rows in order, to the repair with the hash of what is repaired."""
    head, edits, at, state, first, digest = None, "", 0, START, True, hashlib.sha256()
    out: list[dict] = []

    def say(role: str, text: str) -> None:
        nonlocal first
        digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
        first = False

    def insertions() -> None:
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            initial, state = NEXT[state]
            say(NAME[initial], "")
            at += 1

    def closed() -> dict:
        insertions()
        return head | {"repaired_sha256": digest.hexdigest()}

    schema = pa.schema([*[(c.split()[0], pa.int64()) for c in REPAIR.split(", ")[:-1]], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    for rows in batches:
        names = rows.schema.names
        for r in zip(*(rows.column(k).to_pylist() for k in range(len(names)))):
            row = dict(zip(names, r))
            if row["audit"] is not None:
                if head is not None:
                    out.append(closed())
                head, edits, at, state, first, digest = {k: row[k] for k in schema.names[:-1]}, row["audit"], 0, START, True, hashlib.sha256()
                continue
            insertions()
            edit, at = edits[at], at + 1
            if edit == "K":
                say(row["role"], row["text"])
                state = SYSTEM if row["role"].startswith("s") else NEXT[state][1]
            elif edit == "R":
                initial, state = NEXT[state]
                say(NAME[initial], row["text"])
        yield pa.RecordBatch.from_pylist(out, schema)
        out = []
    if head is not None:
        yield pa.RecordBatch.from_pylist([closed()], schema)


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conv_id of rows (conv_id, turn, role, text, there): REPAIRED.

    Rows are taken by turn (nulls first), then role, then text. gaps, blank, duplicate, truncated and illegal describe them as
    they are; cost and audit are of the cheapest edits, and of these the audit least in ASCII; repaired_sha256 is of the
    repaired `role:text` lines. A conversation of which nothing is there has zeros, an empty audit and the hash of nothing.
    A null conv_id is a conversation too; repeated rows are rows; other columns are not read; an empty table gives no rows.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.select("conv_id", "turn", "role", "text", "there").repartition("conv_id")
    own = faults(dealt).sortWithinPartitions(*order, "again")  # of equal rows the first is the one that stays
    found = own.select("conv_id", "turn", "code", "fault").mapInArrow(_scan, REPAIR)
    heads = found.withColumns({"turn": F.lit(None).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    tail = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in REPAIR.split(", ")[1:]}
    lines = dealt.where("there").drop("there").withColumns(tail)
    both = heads.withColumn("line", F.lit(0)).unionByName(lines.withColumn("line", F.lit(1))).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "line", *order[1:]).drop("turn", "line").mapInArrow(_hash, REPAIRED)
