"""SimHash near-deduplication with deletion-variant signatures.

A fingerprint is cut into few segments, so few that one of them differs by at most one bit between any two that are to be
found. Segments are indexed by their one-wildcard variants (a bit wiped out), equal variants make candidates, and a
candidate counts once it is verified. What is indexed are the distinct values of a segment, never the fingerprints that
have them: a value that a third of all rows share is one row there. Values one bit apart agree in one of their two
halves; they meet by that half, and the variants of the other half are made and joined where they meet. So two rows per
value are shuffled instead of one per variant, and no more than 2^(width / 2) values can ever meet, whatever the data.

Two uses: `near_duplicates` links 64-bit fingerprints that differ in at most three bits (two segments of 32 bits; exact).
`one_of_each` drops texts whose shingle sets are alike at 0.8 or more: its fingerprints are as long, and cut into as many
segments, as the number of texts and the similarity ask for, and every candidate is verified on the whole shingle sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import scratch, written
from .components import components

_BITS = np.array([[(b >> (7 - i)) & 1 for i in range(8)] for b in range(256)], np.int32)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle's UTF-8, repeats included; one of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z changes, only ASCII space splits
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_digest
    if n <= width:
        hashes = [h(line, 42)]
    else:
        at = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = [0, *at[: n - width].tolist()]
        hashes = [h(line[s:e], 42) for s, e in zip(starts, (at[width - 1 :] - 1).tolist())]
    return np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 without words.

    Words: ASCII white space apart, A-Z lower-cased. Hash: XXH64 of the shingle's UTF-8 with seed 42. A bit is 1 if set in
    over half of the hashes.
    """
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    grid = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(grid[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(grid)).tobytes(), "big")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 1
            fp = np.array([fingerprint(t.as_py(), width) for t in batch.column(k)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(fp, pa.int64())], names=[*batch.schema.names[:k], "fp"])

    return run


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), width: int = 3, text: str = "text") -> DataFrame:
    """keep + fp (the fingerprint's bits as a signed long), one row per row of docs."""
    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep] + ["fp bigint"])
    return docs.select(*[F.col(k) for k in keep], F.col(text).cast("string").alias("__text")).mapInArrow(_fingerprints(width), schema)


def _wiped(value: Column, low: int, n: int) -> list[Column]:
    """The n bits of value from bit `low`, once for each with that bit set to 1."""
    part = F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    return [part.bitwiseOR(F.lit(1 << i).cast("long")) for i in range(n)]


def _variants(fp: Column, parts: list[tuple[int, int]]) -> Column:
    """An array of (slot, key): for each part (low bit, bits), one entry per wiped bit."""
    return F.array(*[F.struct(F.lit(64 * p + i).alias("slot"), key.alias("key")) for p, (low, n) in enumerate(parts) for i, key in enumerate(_wiped(fp, low, n))])


def one_bit_groups(keyed: DataFrame, width: int, far: int = 64) -> DataFrame:
    """(g, node): nodes whose segments differ in at most one bit are together in a group; so are chains of such segments.

    keyed: (k, node, check), one row per node and segment; k is the segment's number, then its value (`width` bits, even).
    Where at most two nodes have a value, their `check` prints tell whether any of them is within `far` bits of another;
    if not, the value makes no candidates.
    """
    values = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
    half, mask = width // 2, F.lit((1 << width // 2) - 1).cast("long")
    number = F.shiftright("k", width) * 2
    upper, lower = F.shiftright("k", half).bitwiseAND(mask), F.col("k").bitwiseAND(mask)
    side = lambda h, same, rest: F.struct(F.shiftleft(number + h, half).bitwiseOR(same).alias("g"), rest.alias("rest"))
    second = F.when(F.col("n") > 1, F.col("high"))
    halves = values.select(F.explode(F.array(side(0, upper, lower), side(1, lower, upper))).alias("s"), F.least("n", F.lit(3)).cast("int").alias("n"), "low", second.alias("high")).select("s.g", "s.rest", "n", "low", "high")
    near = halves.repartition("g").sortWithinPartitions("g", "rest").mapInArrow(_one_bit(half, far), "k bigint, g bigint")
    return keyed.select("k", "node").join(near.hint("merge"), "k").select("g", "node")


def _one_bit(half: int, far: int):
    """Runs of equal g, sorted: (g, rest, n, low, high) -> (k, g) for values that a variant joins, and for values that several nodes have."""

    def solve(g: np.ndarray, rest: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        low, high = low.view(np.uint64), high.view(np.uint64)
        close = lambda x, y: np.bitwise_count(x ^ y) <= far
        code = (np.cumsum(np.concatenate([[0], g[1:] != g[:-1]])) << half) | rest  # ascending, each once
        a, b = [], []
        for i in range(half):  # the variant without bit i: a value without it meets the one with it
            at = np.flatnonzero(rest & (1 << i) == 0)
            want = code[at] | (1 << i)
            to = np.minimum(np.searchsorted(code, want), len(code) - 1)
            ok = code[to] == want
            at, to = at[ok], to[ok]
            ok = (n[at] > 2) | (n[to] > 2) | close(low[at], low[to]) | close(low[at], high[to]) | close(high[at], low[to]) | close(high[at], high[to])
            a.append(at[ok]), b.append(to[ok])
        root = np.arange(len(g))
        for x, y in zip(np.concatenate(a).tolist(), np.concatenate(b).tolist()):
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            root[max(x, y)] = min(x, y)
        while (deep := root[root] != root).any():
            root[deep] = root[root[deep]]
        second, same = (g >> half) & 1, g & ((1 << half) - 1)
        k = (g >> half + 1 << 2 * half) | np.where(second == 1, rest << half | same, same << half | rest)
        keep = np.bincount(root, minlength=len(g))[root] > 1
        keep |= (second == 0) & ((n > 2) | (n == 2) & close(low, high))
        return pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array((k[root] << 1 | second)[keep])], names=["k", "g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            g, rest, n, low, high = batch.columns
            cols = [c.to_numpy(zero_copy_only=False) for c in (g, rest, n, low, pc.coalesce(high, low))]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            if len(held[0]) and held[0][0] != held[0][-1]:
                cut = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1
                yield solve(*(c[:cut] for c in held))
                held = [c[cut:].copy() for c in held]
        if held is not None and len(held[0]):
            yield solve(*held)

    return run


def _stars(n_bits: int):
    """Edges inside runs of equal keys: every fingerprint to one earlier linked one, enough to join what is linked."""

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b) <= n_bits

    def forest(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links within run (distinct fingerprints), breadth first; no pair list is kept."""
        left, a, b = run, [], []
        while len(left):
            front, left = left[:1], left[1:]
            while len(front) and len(left):
                x, front = front[:1], front[1:]
                hit = near(left, x)
                if hit.any():
                    new = left[hit]
                    a.append(np.repeat(x, len(new), axis=0))
                    b.append(new)
                    front, left = np.concatenate([front, new]), left[~hit]
        return (np.concatenate(a), np.concatenate(b)) if a else (run[:0], run[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[np.ndarray, np.ndarray] | None = None

        def out(g: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            # rows of one group are adjacent; groups of two are the bulk and go vectorised
            edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
            sizes = np.diff(edge)
            i = edge[:-1][sizes == 2]
            ok = near(fp[i], fp[i + 1])
            a, b = [fp[i][ok]], [fp[i + 1][ok]]
            for s, n in zip(edge[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                x, y = forest(np.unique(fp[s : s + n]))
                a.append(x), b.append(y)
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            g, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if last is not None:
                g, fp = np.concatenate([last[0], g]), np.concatenate([last[1], fp])
            if not len(g):
                continue
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
            if cut:
                yield out(g[:cut], fp[:cut])
            last = g[cut:].copy(), fp[cut:].copy()
        if last is not None and len(last[0]):
            yield out(*last)

    return run


def links(distinct: DataFrame, n_bits: int = 3, hot: int = 16_384) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join everything within n_bits <= 3 bits.

    Inside a group's fingerprints only a spanning forest of the links is given: at most one edge per fingerprint and
    group, never all pairs. Groups of over `hot` fingerprints are not compared as they are: the same step is taken on the
    variants of the group's half and on the other half, cut in two and then in two again, so that what meets differs in
    at most 1 + 1 + 1 + 8 bits, 2,048 fingerprints, however large the corpus. Both ways are exact: of three bits at most
    one lies in one of two halves, whatever is halved.
    """
    mask = F.lit((1 << 32) - 1).cast("long")
    parts = F.array(F.col("fp").bitwiseAND(mask), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)))
    keyed = distinct.select(F.explode(parts).alias("k"), F.col("fp").alias("node"), F.lit(0).cast("long").alias("check"))
    groups = one_bit_groups(keyed, 32)
    shared = written(groups.withColumnRenamed("node", "fp"), "simhash-groups")
    sizes = shared.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("g")
    if not sizes.limit(1).count():
        return _paired(shared, n_bits).distinct()
    found = [_paired(shared.join(sizes, "g", "left_anti"), n_bits)]
    crowd = written(shared.join(sizes, "g", "left_semi").select("fp", F.shiftright("g", 33).alias("part")).distinct(), "simhash-crowd")
    for part, own, other in ((0, 0, 32), (1, 32, 0)):
        deep = crowd.where(F.col("part") == part).select("fp", F.explode(_variants(F.col("fp"), [(own, 32)])).alias("v")).select("fp", F.xxhash64("v.slot", "v.key").alias("g"))
        for sixteen, rest in ((other, other + 16), (other + 16, other)):
            first = F.array(*[F.struct(F.lit(100 + i).alias("slot"), k.alias("key")) for i, k in enumerate(_wiped(F.col("fp"), sixteen, 16))])
            second = _variants(F.col("fp"), [(rest, 8), (rest + 8, 8)])
            fine = deep.select("fp", "g", F.explode(first).alias("v")).select("fp", F.xxhash64("g", F.lit(part), F.lit(sixteen), "v.slot", "v.key").alias("g"))
            fine = fine.select("fp", "g", F.explode(second).alias("v")).select("fp", F.xxhash64("g", "v.slot", "v.key").alias("g"))
            many = fine.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
            found.append(_paired(fine.join(many.hint("merge"), "g"), n_bits))
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out.distinct()


def _paired(rows: DataFrame, n_bits: int) -> DataFrame:
    return rows.select("g", "fp").repartition("g").sortWithinPartitions("g").mapInArrow(_stars(n_bits), "a bigint, b bigint")


# Similar texts, beyond copies: the same index over longer fingerprints, links by the shingle sets themselves.


@dataclass(frozen=True)
class Cut:
    """How fingerprints are cut so that of pairs alike at `similarity` a share of 1 - miss have a segment that differs in
    at most one bit, while texts that have nothing in common rarely do: segments grow with the number of texts."""

    similarity: float
    width: int  # bits of a segment
    segments: int

    @classmethod
    def of(cls, texts: int, similarity: float, miss: float) -> Cut:
        width = max(16, 2 * math.ceil((math.log2(max(texts, 2)) + 6) / 2))
        p = cls(similarity, 0, 0).differ
        one = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
        return cls(similarity, width, math.ceil(math.log(miss) / math.log1p(-one)))

    @property
    def differ(self) -> float:
        """Chance that a bit differs between two sets at the similarity: their angle (the widest, of equal sizes) by pi."""
        return math.acos(min(1.0, 2 * self.similarity / (1 + self.similarity))) / math.pi

    @property
    def lanes(self) -> int:
        """64-bit words of a print: the segments, and one more as a check."""
        return -(-self.width * self.segments // 64) + 1

    def far(self, bits: int, deviations: float) -> int:
        """Bits of `bits` that differ at most at the similarity, but for so many standard deviations."""
        return math.ceil(bits * self.differ + deviations * math.sqrt(bits * self.differ * (1 - self.differ)))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; none without words."""
    return np.unique(shingle_hashes(text, width))


def long_print(shingles: np.ndarray, lanes: int) -> np.ndarray:
    """SimHash of a shingle set in `lanes` 64-bit words, as bits; every shingle has a weight of its own between 1/2 and 3/2,
    so that sums of a few shingles do not tie. All 0 for an empty set."""
    if not len(shingles):
        return np.zeros(64 * lanes, np.uint8)
    weight, sums = 0.5 + (shingles >> np.uint64(44) & np.uint64(255)).astype(float) / 255, np.zeros((8 * lanes, 256))
    offset = np.arange(8 * lanes) * 256
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] * _turns(lanes)
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(32)
        codes = part.astype(">u8").view(np.uint8).reshape(len(part), -1) + offset
        sums += np.bincount(codes.ravel(), np.repeat(weight[at : at + 2048], 8 * lanes), sums.size).reshape(sums.shape)
    return (sums @ _BITS > weight.sum() / 2).astype(np.uint8).ravel()


@functools.cache
def _turns(lanes: int) -> np.ndarray:
    return np.random.default_rng(42).integers(0, 1 << 63, lanes, np.uint64) * np.uint64(2) + np.uint64(1)


def _signed(hashes: list[int]) -> np.ndarray:
    return np.array(hashes, np.uint64).view(np.int64)


def _printed(width: int, cut: Cut):
    """(.., text) -> (.., node, print): the hash of the shingle set, the words of its print; without words an empty print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            k = batch.num_columns - 1
            node, prints = [], []
            for t in batch.column(k):
                own = shingle_set(t.as_py(), width)
                node.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                prints.append(np.packbits(long_print(own, cut.lanes)).view(">i8").astype(np.int64) if len(own) else [])
            made = [pa.array(_signed(node)), pa.array(prints, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), *made], names=[*batch.schema.names[:k], "node", "print"])

    return run


def _segments(cut: Cut):
    """(node, print) -> (k, node, check): one row of each segment of each print."""
    powers = (1 << np.arange(cut.width)[::-1]).astype(np.int64)
    number = np.arange(cut.segments, dtype=np.int64) << cut.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(1)), 0))
            node, words = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, cut.lanes)
            bits = np.unpackbits(words.astype(">i8").view(np.uint8), axis=1)[:, : cut.width * cut.segments]
            k = bits.reshape(-1, cut.segments, cut.width) @ powers | number
            spread = lambda x: pa.array(np.repeat(x, cut.segments))
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), spread(node), spread(words[:, -1])], names=["k", "node", "check"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            k = batch.num_columns - 1
            sets = [shingle_set(t.as_py(), width).view(np.int64) for t in batch.column(k)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(sets, pa.list_(pa.int64()))], names=[*batch.schema.names[:k], "s"])

    return run


def _forest(cut: Cut):
    """Runs of equal (c, i, j): a spanning forest of the links in them, as (a, b); no pair list is kept.

    Rows are (c, i, j, node, block, print, s). Where i and j differ, only nodes of different blocks are compared. Two nodes
    not yet joined are looked at if their prints are close, and joined if their whole sets are alike.
    """
    far = cut.far(64 * cut.lanes, 3)

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        if len(x) < cut.similarity * len(y) - 1e-9:
            return False
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        common = int((y[at] == x).sum())
        return common >= cut.similarity * (len(x) + len(y) - common) - 1e-9

    def solve(t: pa.Table) -> tuple[list[int], list[int]]:
        node, block = t.column("node").to_numpy(), t.column("block").to_numpy()
        words = np.stack(t.column("print").to_pylist()).astype(np.int64).view(np.uint64)
        flat = t.column("s").combine_chunks()
        ends, values = flat.offsets.to_numpy(), flat.values.to_numpy().view(np.uint64)  # as they are sorted
        sets = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
        across = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        tree, a, b = np.arange(len(node)), [], []
        for x in range(len(node) - 1):
            near = x + 1 + np.flatnonzero(tree[x + 1 :] != tree[x])
            near = near[block[near] != block[x]] if across else near
            if not len(near):
                continue
            near = near[np.bitwise_count(words[near] ^ words[x]).sum(axis=1, dtype=np.int64) <= far]
            for y in near.tolist():
                if tree[y] != tree[x] and alike(sets[x], sets[y]):
                    tree[tree == tree[y]] = tree[x]
                    a.append(int(node[x])), b.append(int(node[y]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not len(t):
                continue
            key = np.stack([t.column(c).to_numpy() for c in ("c", "i", "j")])
            edge = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
            for s, e in zip(edge, edge[1:]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in solve(t.slice(s, e - s))], names=["a", "b"])
            held = t.slice(edge[-1])  # the last run may go on
        if held is not None and len(held):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in solve(held)], names=["a", "b"])

    return run


def similar_groups(base: DataFrame, distinct: DataFrame, width: int, cut: Cut, block: int) -> DataFrame:
    """(node, root) of shingle sets that chains of pairs, each truly alike at the cut's similarity, join.

    base has __uid and __text; distinct has one row per set: node, __uid (of a text with that set), print. Sets with a
    segment within one bit are candidates, and what candidates chain together is a cluster. The sets of a cluster meet in
    one task, or, beyond `block` shingles, dealt into blocks, in one task per pair of blocks; each gives a spanning forest
    of the links that it verifies on the whole sets. So a pair is never a row, and no set travels once per segment.
    """
    keyed = distinct.select("node", "print").mapInArrow(_segments(cut), "k bigint, node bigint, check bigint")
    groups = written(one_bit_groups(keyed, cut.width, cut.far(64, 4)), "similar-groups")
    first = groups.groupBy("g").agg(F.min("node").alias("a"))
    clusters = written(components(groups.join(first.hint("merge"), "g").select("a", F.col("node").alias("b")).distinct()), "similar-clusters").select("node", F.col("root").alias("c"))
    some = distinct.select("node", "__uid", "print").join(clusters.hint("merge"), "node")
    sets = base.select("__uid", "__text").join(some.hint("merge"), "__uid").select("c", "node", "print", "__text").mapInArrow(_sets(width), "c bigint, node bigint, print array<bigint>, s array<bigint>")
    sets = written(sets, "similar-sets")
    blocks = sets.groupBy("c").agg(F.ceil(F.sum(F.size("s")) / block).alias("blocks"))
    dealt = sets.join(blocks.hint("merge"), "c").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = dealt.select("c", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "print", "s")
    links = rows.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j").mapInArrow(_forest(cut), "a bigint, b bigint")
    return components(links)


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, miss: float = 0.01, block: int = 1_000_000) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest doc_id stays, whole.

    Rows are alike at a true Jaccard similarity of their sets of word shingles of `similarity` or more, and a group is what
    chains of such pairs join; no pair below it is ever linked. Of pairs at exactly `similarity` a share of `miss` is
    overlooked, of those above less (see Cut; at any number of rows). Null, empty and word-less texts
    are alike. Null doc_ids come last; among rows with the same doc_id the first read stays. An empty table stays empty; all
    columns of docs are kept.
    """
    with scratch() as temp:
        base = temp.keep(written(docs.withColumn("__uid", F.monotonically_increasing_id()), "similar-docs"))  # one numbering for all uses
        cut = Cut.of(base.count(), similarity, miss)
        text = F.col("text").cast("string").alias("__text")
        prints = base.select("__uid", "doc_id", text).mapInArrow(_printed(width, cut), f"__uid bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, node bigint, print array<bigint>")
        prints = written(prints, "similar-prints")
        distinct = prints.groupBy("node").agg(F.min(F.struct("__uid", "print")).alias("m"))
        distinct = written(distinct.select("node", "m.*"), "similar-distinct")
        groups = similar_groups(base.select("__uid", text), distinct, width, cut, block)
        grouped = prints.select("node", "doc_id", "__uid").join(groups, "node", "left").select(F.coalesce("root", "node").alias("g"), "doc_id", "__uid")
        first = grouped.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__uid")).alias("m"))
        first = temp.keep(written(first.select(F.col("m.__uid").alias("__uid")), "similar-first"))
    return base.join(first.hint("merge"), "__uid", "left_semi").select(*docs.columns)


def near_duplicates(docs: DataFrame, width: int = 3, n_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of at most n_bits bits reach.

    Empty, null and word-less texts have fingerprint 0 and link like any other. Repeated rows stay. A null doc_id takes
    part; a component of null ids only has a null component_id. An empty table gives no rows. Other columns are not read.
    """
    with scratch() as temp:
        prints = temp.keep(written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ("doc_id",), width), "simhash-fp"))
        distinct = temp.keep(written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct"))
        roots = temp.keep(written(components(links(distinct.select("fp"), n_bits)), "simhash-roots"))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")
