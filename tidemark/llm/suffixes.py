"""Exact removal of long repeated byte strings, by merging shards of a suffix order.

A string of `length` bytes that starts in two places is found through one of its own positions: the anchor, where the
smallest hash of its `gram`-byte substrings lies (the rightmost of equals). Equal strings have equal anchors at equal
offsets, so only suffixes that start at anchors are ever ordered: a Burrows-Wheeler transform sampled where the text
itself says, with the bytes before the anchor in place of the one preceding symbol.

1. Each shard (task) finds the anchors of its texts and the range of starts each anchor stands for. Contexts that are
   equal as a whole collapse to one, however many copies; anchors that then have one context only need no order.
2. The contexts of an anchor come to one task as runs, each run a shard's piece of the order. They are merged by
   refining an interleave, as in Holt and McMillan (2014): start with the runs one after the other, and in round h
   split every interval whose members still agree by symbol h of the context (a word of eight bytes), stably. The round
   in which neighbours part is their common prefix; no suffix is sorted as a whole.
3. The same refinement over the bytes before the anchor gives common suffixes. A start d bytes before the anchor is
   repeated if and only if another context agrees in d bytes before and length - d bytes after it, that is, lies in the
   same interval of both orders at these depths.

Anchors with more distinct contexts than `hot` are not gathered: their starts are counted by a hash of the whole string,
one grouped sum that combines on the map side; the result is the same either way. Rows are never brought together by an
anchor's hash alone, only its distinct contexts, and of these no more than `hot`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import few, scratch, written

_LOW = np.uint64((1 << 24) - 1)
_CHUNK = 1 << 18  # bytes of text hashed at a time; must stay below 2^24 with the longest text cut by _SLICE
_SLICE = 1 << 22


def _table() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_T = _table()
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xA0761D6478BD642F)]


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of every gram-byte substring; gram is a sum of powers of two, built by doubling."""
    powers = {1: _T[b]}
    size, k = 1, 0
    while size * 2 <= gram:
        h = powers[size]
        powers[size * 2] = h[:-size] * _M[k] + h[size:]
        size, k = size * 2, k + 1
    out, done = powers[size], size
    while done < gram:
        size = 1 << ((gram - done).bit_length() - 1)
        tail = powers[size][done:]
        out = out[: len(tail)] * _M[7] + tail
        done += size
    out = out ^ (out >> np.uint64(31))
    out = out * _M[4]
    return out ^ (out >> np.uint64(29))


def _window_min(key: np.ndarray, width: int) -> np.ndarray:
    size, low = 1, key
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(low) - (width - size)], low[width - size :]) if width > size else low


def anchors(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a byte array: anchor position, first start, number of starts, anchor hash, for every run of starts that share one."""
    n = len(raw)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    h = _gram_hashes(raw, gram)
    key = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
    at = (_LOW - (_window_min(key, length - gram + 1) & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.diff(np.append(first, len(at))), h[at[first]]


def _anchor_rows(length: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(th, nb, text) -> (th, nb, pos, own, off, seed, ctx): pos the first start, own their number, off the anchor after pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            th, nb = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            texts = [t.as_py().encode("utf-8", "surrogatepass") if n >= length else b"" for t, n in zip(batch.column(2), nb)]
            out: list[tuple] = []
            todo = [i for i in range(len(texts)) if nb[i] >= length]
            while todo:
                part, size = [], 0
                while todo and size < _CHUNK:
                    part.append(todo.pop())
                    size += len(texts[part[-1]])
                if len(part) == 1 and size > _SLICE:  # a very long text, slice by slice: starts are dealt out once
                    i = part[0]
                    for a in range(0, size - length + 1, _SLICE):
                        b, s, k, h = anchors(np.frombuffer(texts[i], np.uint8)[a : a + _SLICE + length - 1], length, gram)
                        out.append((np.full(len(b), i), b + a, s + a, k, h))
                    continue
                joined = np.frombuffer(b"".join([texts[i] for i in part]), np.uint8)
                ends = np.cumsum([len(texts[i]) for i in part])
                b, s, k, h = anchors(joined, length, gram)
                # cut runs of starts at the ends of documents, and drop starts whose string would cross one
                d = np.searchsorted(ends, s, side="right")
                while True:
                    stop = s + k
                    over = stop > ends[d]
                    if not over.any():
                        break
                    b, s, k, h, d = (np.concatenate(x) for x in ((b, b[over]), (s, ends[d[over]]), (np.where(over, ends[d] - s, k), (stop - ends[d])[over]), (h, h[over]), (d, d[over] + 1)))
                k = np.minimum(k, ends[d] - length + 1 - s)
                ok = k > 0
                b, s, k, h, d = b[ok], s[ok], k[ok], h[ok], d[ok]
                start = (ends - [len(texts[i]) for i in part])[d]
                out.append((np.array(part)[d], b - start, s - start, k, h))
            if not out:
                continue
            d, b, s, k, h = (np.concatenate(x) for x in zip(*out))
            ctx = np.fromiter((xxhash.xxh64_intdigest(texts[i][x : x + y + length - 1], seed=z) for i, x, y, z in zip(d.tolist(), s.tolist(), k.tolist(), (b - s).tolist())), np.uint64, len(d))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (th[d], nb[d].astype(np.int32), s.astype(np.int32), k.astype(np.int32), (b - s).astype(np.int32), h.view(np.int64), ctx.view(np.int64))], names=["th", "nb", "pos", "own", "off", "seed", "ctx"]
            )

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        k = batch.num_columns - 1
        z = [pack.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column(k)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(z, pa.binary())], names=[*batch.schema.names[:k], "z"])


def _contexts(length: int, hot: bool):
    """(z, list of contexts) -> rows of contexts' bytes in suffix order, or, for hot anchors, a row per start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, unpack = TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            rows = []
            for z, found in zip(batch.column(0), batch.column(1)):
                raw = unpack.decompress(z.as_py())
                rows += [(c["seed"], c["ctx"], c["n"], c["off"], c["own"], raw[c["pos"] : c["pos"] + c["own"] + length - 1]) for c in found.as_py()]
            if hot:
                flat = [(int.from_bytes(g[:8], "big", signed=True), int.from_bytes(g[8:], "big", signed=True), r[0], r[1], r[2], i) for r in rows for i in range(r[4]) for g in (xxhash.xxh3_128_digest(r[5][i : i + length]),)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*flat)) or [()] * 6, [pa.int64()] * 5 + [pa.int32()])], names=["w1", "w2", "seed", "ctx", "n", "start"])
                continue
            rows.sort(key=lambda r: (r[0], r[5][r[3] :]))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds)), pa.array([shard] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32())], names=["seed", "ctx", "n", "off", "own", "bytes", "shard", "place"])

    return run


def _refine(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge runs by refining their interleave: (order, common prefix in bytes with the one before; -1 between groups).

    words: symbols of each context, one column a round; group: ascending ids within which contexts are merged.
    """
    n, rounds = words.shape
    order = np.arange(n)
    common = np.where(np.concatenate([[True], group[1:] != group[:-1]]), -1, 8 * rounds)
    for h in range(rounds):
        start = common < 8 * rounds
        inner = ~start
        active = inner.copy()
        active[:-1] |= inner[1:]
        at = np.flatnonzero(active)
        if not len(at):
            break
        interval = np.cumsum(start)[at]
        w = words[order[at], h]
        if (w[1:] == w[:-1])[interval[1:] == interval[:-1]].all():
            continue
        o = np.lexsort((w, interval))
        order[at], w = order[at[o]], w[o]
        x = w[1:] ^ w[:-1]
        part = np.flatnonzero((interval[1:] == interval[:-1]) & (x != 0))
        x, same = x[part], np.zeros(len(part), np.int64)
        for byte in range(7):  # leading bytes that agree
            same += (x >> np.uint64(8 * (7 - byte))) == 0
        common[at[part + 1]] = 8 * h + same
    return order, common


def repeated_starts(group: np.ndarray, off: np.ndarray, own: np.ndarray, contexts: list[bytes], length: int) -> np.ndarray:
    """Boolean (context, d): the start d bytes before the anchor is also found in another context of its group."""
    n = len(contexts)
    after, before = -(-length // 8), -(-int(off.max() + 1) // 8)
    right, left = np.zeros((n, after * 8), np.uint8), np.zeros((n, max(before, 1) * 8), np.uint8)
    for i, (c, o) in enumerate(zip(contexts, off.tolist())):
        tail = c[o : o + length]
        right[i, : len(tail)] = np.frombuffer(tail, np.uint8)
        if o:
            left[i, :o] = np.frombuffer(c[:o][::-1], np.uint8)
    views = []
    for grid in (right, left):
        order, common = _refine(grid.view(">u8").astype(np.uint64), group)
        near = np.maximum(common, np.append(common[1:], -1))
        views.append((order, common, near[np.argsort(order)]))
    (r_order, r_common, r_near), (l_order, l_common, l_near) = views
    lo, hi = np.maximum(off - own + 1, length - r_near), np.minimum(off, l_near)
    marks = np.zeros((n, int(off.max()) + 1), bool)
    if not (lo <= hi).any():
        return marks
    r_rank, l_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(max(0, int(lo[lo <= hi].min())), int(hi[lo <= hi].max()) + 1):
        who = np.flatnonzero((lo <= d) & (d <= hi))
        if len(who) < 2:
            continue
        r_rank[r_order] = np.cumsum(r_common < length - d)
        l_rank[l_order] = np.cumsum(l_common < d)
        key = r_rank[who] * (n + 1) + l_rank[who]
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        marks[who[times[back] > 1], d] = True
    return marks


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _merge(length: int, block: int = 4096):
    """Sorted (seed, ctx, n, off, own, bytes, ..) -> (seed, ctx, lo, hi): ranges of repeated starts of contexts with n = 1."""

    def solve(cols: list[list]) -> pa.RecordBatch:
        seed, ctx = np.array(cols[0], np.int64), np.array(cols[1], np.int64)
        off, own = np.array(cols[3], np.int64), np.array(cols[4], np.int64)
        group = np.cumsum(np.concatenate([[True], seed[1:] != seed[:-1]]))
        marks = repeated_starts(group, off, own, cols[5], length)
        rows = [(seed[i], ctx[i], lo, hi) for i in np.flatnonzero(marks.any(1) & (np.array(cols[2]) == 1)).tolist() for lo, hi in _ranges(marks[i, off[i] - own[i] + 1 : off[i] + 1][::-1])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])], names=["seed", "ctx", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        for batch in batches:
            for k in range(6):
                held[k] += batch.column(k).to_pylist()
            if len(held[0]) >= block:
                last = held[0][-1]
                cut = next((i for i in range(len(held[0]) - 1, -1, -1) if held[0][i] != last), -1) + 1
                if cut:
                    yield solve([c[:cut] for c in held])
                    held = [c[cut:] for c in held]
        if held[0]:
            yield solve(held)

    return run


def repeated_ranges(docs: DataFrame, length: int = 400, gram: int = 80, hot: int = 20_000) -> DataFrame:
    """(th, nb, starts): of each distinct text with a repeat (named by its hash and bytes), the ranges [lo, hi) of starts
    of `length`-byte strings that also start elsewhere, in it or in any other row."""
    with scratch() as temp:
        return temp.keep(_repeated_ranges(docs, length, gram, hot))


def _seen_again(found: DataFrame, hot: int) -> DataFrame:
    """The rows of found whose seed is there twice or more; rows of a seed seen over `hot` times stay where they are."""
    times = written(found.groupBy("seed").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "sfx-times")
    busy = times.where(F.col("times") > hot).select("seed")
    if not busy.limit(1).count():
        return found.join(times.select("seed").hint("merge"), "seed", "left_semi")
    busy = few(busy)
    calm = found.join(busy, "seed", "left_anti").join(times.where(F.col("times") <= hot).select("seed").hint("merge"), "seed", "left_semi")
    return calm.unionByName(found.join(busy, "seed", "left_semi"))


def _repeated_ranges(docs: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    named = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(F.xxhash64("text").alias("th"), F.octet_length("text").alias("nb"), "text").where(F.col("nb") >= length)
    found = written(named.mapInArrow(_anchor_rows(length, gram), "th bigint, nb int, pos int, own int, off int, seed bigint, ctx bigint"), "sfx-anchors")
    again = written(_seen_again(found, hot), "sfx-again")
    # one row per context, however many rows have it; combined on the map side
    contexts = written(again.groupBy("seed", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("th", "nb", "pos", "own", "off")).alias("at")), "sfx-contexts")
    seeds = written(contexts.groupBy("seed").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sfx-seeds")
    crowded = seeds.where(F.col("m") > hot).select("seed")
    any_crowded = crowded.limit(1).count() > 0
    crowded = few(crowded) if any_crowded else crowded
    texts = named.mapInArrow(_squeeze, "th bigint, nb int, z binary").groupBy("th", "nb").agg(F.first("z").alias("z"))

    def with_text(some: DataFrame, hot_ones: bool, schema: str) -> DataFrame:
        per_text = some.select("at.th", "at.nb", F.struct("seed", "ctx", "n", "at.pos", "at.own", "at.off").alias("c")).groupBy("th", "nb").agg(F.collect_list("c").alias("found"))
        return texts.join(per_text.hint("merge"), ["th", "nb"]).select("z", "found").mapInArrow(_contexts(length, hot_ones), schema)

    calm = contexts.join(crowded, "seed", "left_anti") if any_crowded else contexts  # no seed has over `hot` contexts here
    calm = calm.join(seeds.where(F.col("m") <= hot).select("seed").hint("merge"), "seed")
    rows = with_text(calm, False, "seed bigint, ctx bigint, n bigint, off int, own int, bytes binary, shard int, place int")
    merged = rows.repartition("seed").sortWithinPartitions("seed", "shard", "place").mapInArrow(_merge(length), "seed bigint, ctx bigint, lo int, hi int")
    if any_crowded:
        starts = with_text(contexts.join(crowded, "seed", "left_semi"), True, "w1 bigint, w2 bigint, seed bigint, ctx bigint, n bigint, start int")
        starts = written(starts, "sfx-starts")
        twice = starts.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1").select("w1", "w2")
        merged = merged.unionAll(starts.where("n = 1").join(twice, ["w1", "w2"], "left_semi").select("seed", "ctx", F.col("start").alias("lo"), (F.col("start") + 1).alias("hi")))
    # every start of a context that two rows have is repeated; contexts that very many rows have go by themselves
    many = contexts.where(F.col("n") > hot).select("seed", "ctx")
    marks = merged.unionAll(contexts.where("n > 1").where(F.col("n") <= hot).select("seed", "ctx", F.lit(0).alias("lo"), F.col("at.own").alias("hi")))
    rare, common = again, None
    if many.limit(1).count():
        many = few(many)
        rare = again.join(many, ["seed", "ctx"], "left_anti")
        common = again.join(many, ["seed", "ctx"], "left_semi").select("th", "nb", F.col("pos").alias("lo"), (F.col("pos") + F.col("own")).alias("hi"))
    parts = rare.join(marks.hint("merge"), ["seed", "ctx"]).select("th", "nb", (F.col("pos") + F.col("lo")).alias("lo"), (F.col("pos") + F.col("hi")).alias("hi"))
    parts = parts.unionAll(common) if common is not None else parts
    return written(parts.groupBy("th", "nb").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("starts")), "sfx-ranges")


def spans(starts: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs of sorted ranges of starts."""
    out: list[tuple[int, int]] = []
    for r in starts or ():
        a, b = r["lo"], r["hi"] + length - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def wordy(raw: bytes, starts: list[dict] | None, length: int, words: int) -> list[dict]:
    """Of sorted ranges of starts, joined where they touch, those whose strings together span over `words` whole words."""
    joined: list[dict] = []
    for r in starts or ():
        if joined and r["lo"] <= joined[-1]["hi"]:
            joined[-1]["hi"] = max(joined[-1]["hi"], r["hi"])
        else:
            joined.append(dict(r))
    space, out = b" \t\n\x0b\x0c\r", []
    for r in joined:
        a, b = r["lo"], r["hi"] + length - 1
        n = len(raw[a:b].split())
        n -= 0 < a and raw[a - 1] not in space and raw[a] not in space  # begins inside a word
        n -= b < len(raw) and raw[b] not in space and raw[b - 1] not in space  # ends inside one
        if n > words:
            out.append(r)
    return out


def kept_bytes(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    at, keep = 0, []
    for a, b in cut:
        keep.append(raw[at:a])
        at = b
    return b"".join([*keep, raw[at:]])


def _apply(length: int, rewrite: bool, words: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            k = batch.num_columns - 2
            got = []
            for z, starts in zip(batch.column(k), batch.column(k + 1)):
                raw, starts = unpack.decompress(z.as_py()), starts.as_py()
                cut = spans(starts if words is None else wordy(raw, starts, length, words), length)
                if rewrite:  # whole characters only: one that is cut in part stays
                    safe = []
                    for a, b in cut:
                        while a < b and raw[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                            b -= 1
                        safe.append((a, b))
                    got.append((kept_bytes(raw, safe).decode("utf-8", "surrogatepass"), [{"start": a, "end": b} for a, b in cut]))
                else:
                    got.append((len(raw), sum(b - a for a, b in cut), len(cut), hashlib.sha256(kept_bytes(raw, cut)).hexdigest()))
            keep = [batch.column(i) for i in range(k)]
            if rewrite:
                kinds, names = [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))], ["text", "removed"]
            else:
                kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.string()], ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(c, t) for c, t in zip(list(zip(*got)) or [()] * len(kinds), kinds))], names=[*batch.schema.names[:k], *names])

    return run


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), length: int = 400, gram: int = 80, hot: int = 20_000, rewrite: bool = False, words: int | None = None) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts anywhere else in the rows of docs.

    All copies go, also within one text; matches never cross rows; strings are judged on the input. Returns keep plus
    n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256; with rewrite, keep plus text (what is left, a
    character cut in part stays whole) and removed (the byte spans). One row per row of docs; a null text is empty, and
    texts under `length` bytes lose nothing. Repeated rows repeat each other's strings. length - gram >= 1.

    With words, only strings of over `words` whole words go: unbroken runs of repeated `length`-byte strings count as one.
    """
    ranges = repeated_ranges(docs, length, gram, hot)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(k) for k in keep], F.xxhash64(text).alias("__th"), F.octet_length(text).alias("__nb"), text.alias("__t"))
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    small = rows.mapInArrow(_squeeze, f"{kinds}, __th bigint, __nb int, z binary")
    joined = small.join(ranges.withColumnsRenamed({"th": "__th", "nb": "__nb"}).hint("merge"), ["__th", "__nb"], "left").select(*keep, "z", "starts")
    out = "text string, removed array<struct<start:int,end:int>>" if rewrite else "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return joined.mapInArrow(_apply(length, rewrite, words), f"{kinds}, {out}")
