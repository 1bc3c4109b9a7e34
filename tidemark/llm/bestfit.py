"""Best-fit packing of uncut documents by bin completion.

Only the lengths of pieces matter to a packing, and there are no more of them than a sequence has tokens. So the documents
are tokenised once, where they lie; their lengths are counted on the cluster; and the plan is made over those counts: a
list of fillings (which lengths lie together) with how many sequences are filled that way. A piece then finds its place by
arithmetic from its rank among the pieces of its length. No text moves, and the plan covers all documents at once, so
that the number of sequences does not depend on how the table is split into files and tasks.

The plan comes from a branch-and-bound search over fillings (`plan`). Its work depends on the lengths, not on how many
documents have them.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import few, scratch, written

Filling = tuple[int, ...]  # lengths of one sequence, longest first


# the plan


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """A lower bound: for every a, pieces over capacity - a are alone, those over half get one sequence each, and pieces
    from a up that do not fit beside the latter need sequences of their own (a = 0 gives the sum over the capacity)."""
    size = np.arange(capacity + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * size)
    half, best = capacity // 2, 0
    for a in range(half + 1):
        top = capacity - a
        alone, large = n[-1] - n[top], n[top] - n[half]
        below = a - 1 if a else 0
        small = total[half] - total[below]
        room = capacity * large - (total[top] - total[half])
        best = max(best, int(alone + large + max(0, -(-(small - room) // capacity))))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over counted lengths: each piece joins the fullest sequence that has room for it."""
    open_: dict[int, dict[Filling, int]] = defaultdict(dict)  # room -> fillings and how many sequences have them
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                per = capacity // length
                whole, rest = divmod(left, per)
                for n, k in ((whole, per), (1, rest)):
                    if n and k:
                        key, at = (length,) * k, open_[capacity - k * length]
                        at[key] = at.get(key, 0) + n
                left = 0
                break
            same = open_[room]
            filling, n = same.popitem()
            if not same:
                del open_[room]
            per = min(room // length, -(-left // n))
            whole = min(n, left // per)
            for m, k in ((whole, per), (1 if whole < n and left > whole * per else 0, left - whole * per)):
                if m:
                    key, at = filling + (length,) * k, open_[room - k * length]
                    at[key] = at.get(key, 0) + m
                    left -= m * k
                    n -= m
            if n:
                open_[room][filling] = n
    return [(f, n) for same in open_.values() for f, n in same.items()]


def _fits_into(inner: Filling, outer: Filling) -> bool:
    """Whether the pieces of inner can be dealt out to those of outer, none of which they exceed in sum (dominance)."""
    if not inner:
        return True
    for k, size in enumerate(outer):
        if size >= inner[0] and _fits_into(inner[1:], tuple(sorted((*outer[:k], size - inner[0], *outer[k + 1 :]), reverse=True))):
            return True
    return False


def fillings(counts: np.ndarray, room: int, waste: int, width: int = 16, price: int = 0) -> list[Filling]:
    """Undominated ways to fill the room beside the largest piece, those that waste least first, a piece priced as so
    many wasted tokens: small pieces are worth keeping for later.

    Every one leaves at most `waste` and too little for any further piece. One filling dominates another if it can be
    swapped for it in any packing: where the other's pieces can be dealt out to its own. A piece that fills the room
    exactly dominates all; fillings of over five pieces are not asked. At most `width` candidates are listed before the dominated ones go: the search is complete
    where fewer exist.
    """
    sizes = np.flatnonzero(counts[: room + 1])
    if not len(sizes):
        return [()] if room <= waste else []
    if sizes[-1] == room:
        return [(room,)]
    found: list[Filling] = []
    least, up, tries = int(sizes[0]), sizes.tolist(), 0
    pairs = sizes[counts[room - sizes] > (2 * sizes == room)]
    found += [(int(a), int(room - a)) for a in pairs[2 * pairs >= room][::-1][: width // 4]]  # these waste nothing

    def extend(part: list[int], left: int, k: int) -> None:
        nonlocal tries
        for j in range(min(k, bisect.bisect_right(up, left) - 1), -1, -1):
            tries += 1
            if len(found) >= width or tries > 20 * width:
                return
            size = up[j]
            if part.count(size) >= counts[size]:
                continue
            part.append(size)
            rest = left - size
            if rest < least or all(part.count(s) >= counts[s] for s in itertools.takewhile(lambda s: s <= rest, up)):
                if rest <= waste:
                    found.append(tuple(part))
            else:
                extend(part, rest, j)
            part.pop()

    extend([], room, len(up) - 1)
    kept: list[Filling] = []
    for f in sorted(dict.fromkeys(found), key=lambda f: (room - sum(f), len(f), [-x for x in f])):
        if len(f) > 5 or not any(_fits_into(f, g) for g in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: room - sum(f) + price * len(f))


@dataclass
class Plan:
    fillings: list[tuple[Filling, int]]
    bins: int
    least: int  # no packing has fewer sequences
    searched: bool  # the fillings come from the search; otherwise best fit was not reached by it
    nodes: int


#: Prices of a piece, each with its own share of the nodes.
PRICES = (8, 2, 0, 32)


def plan(counts: np.ndarray, capacity: int, nodes: int = 12_000, width: int = 16) -> Plan:
    """Fillings for all pieces: bin completion by branch and bound, with best-fit decreasing as the first incumbent.

    counts[l]: pieces of length l, 1 <= l <= capacity. A node takes the largest piece left and branches over the
    undominated fillings around it, each used as often as the counts allow, then half as often, down to once. What a
    branch has wasted must leave a chance of no more sequences than the incumbent has (of fewer, once the search has
    found a packing of its own). It ends when the lower bound is met, all is searched, or `nodes` nodes are used, with the
    best found so far; every result places every piece. The nodes are shared out to searches with other PRICES.
    """
    counts = np.asarray(counts, np.int64)
    fitted = best_fit(counts, capacity)
    found = Plan(fitted, sum(n for _, n in fitted), least_bins(counts, capacity), False, 0)
    for price in PRICES:
        if counts.any() and not (found.searched and found.bins == found.least) and _search(counts, capacity, found, nodes // len(PRICES), width, price):
            break
    return found


def _search(counts: np.ndarray, capacity: int, found: Plan, nodes: int, width: int, price: int) -> bool:
    """Depth-first from the least priced fillings; betters `found`. True if nothing is left to search."""
    total = int((counts * np.arange(capacity + 1)).sum())
    left, wasted, used, seen = counts.copy(), 0, 0, 0
    path: list[tuple[Filling, int]] = []  # fillings chosen, and how often

    def spare() -> int:
        """Tokens that may be wasted yet."""
        return (found.bins - found.searched) * capacity - total - wasted

    def options() -> Iterator[tuple[Filling, int]]:
        size = int(np.flatnonzero(left)[-1])
        left[size] -= 1
        ways = fillings(left, capacity - size, spare(), width, price) if spare() >= 0 else []
        left[size] += 1
        for way in ways:
            whole = (size, *way)
            lengths, need = np.unique(whole, return_counts=True)
            times = int((left[lengths] // need).min())
            if waste := capacity - sum(whole):
                times = min(times, spare() // waste)
            while times > 0:
                yield whole, times
                times //= 2

    def put(whole: Filling, times: int) -> None:
        nonlocal wasted, used
        np.subtract.at(left, list(whole), times)
        wasted, used = wasted + times * (capacity - sum(whole)), used + times

    stack = [options()]
    while stack and seen < nodes and not (found.searched and found.bins == found.least):
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                whole, times = path.pop()
                put(whole, -times)
            continue
        whole, times = step
        if times * (capacity - sum(whole)) > spare():
            continue
        seen += 1
        put(whole, times)
        if left.any():
            path.append(step)
            stack.append(options())
            continue
        found.fillings, found.bins, found.searched = [*path, step], used, True
        put(whole, -times)
    found.nodes += seen
    return not stack


def places(made: Plan, capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: ranks at which runs of places begin, the sequence of each run's first place, and the offset in it."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    first = 0
    for filling, n in made.fillings:
        offset = 0
        for length in filling:
            runs[length].append((taken[length], first, offset))
            taken[length] += n
            offset += length
        first += n
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows)) for length, rows in runs.items()}


# tokens


class ByteEncoder:
    """Ids of texts by a byte-level BPE file, as little-endian uint32 bytes.

    Three ways that give the same ids. Texts of printable Latin characters with single spaces are split at the spaces:
    no piece of the tokenizer reaches over one, so a text's ids are those of its chunks, which are kept (`keep` of
    them, then afresh); new chunks are encoded in one call, and told apart again by the tokens that begin with a space.
    Latin texts with other white space are merged whole by rank: a vocabulary in the order of its merges gives the same
    tokens as the merge list. All other texts, and those with a special token's string, go to the tokenizer itself.
    """

    _OTHER = re.compile(r"[^\x09-\x0D\x20-\x7E\xA1-\xAC\xAE-ɏ]")
    # Fixed value: how byte-level BPE splits a text into pieces.
    _PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, keep: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file spells as themselves
        spelt = dict(zip(map(chr, printable), printable)) | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(spelt[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self._bpe = tiktoken.Encoding("bytes", pat_str=self._PIECES, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._spaced = np.zeros(max(ranks.values()) + 1, bool)
        self._spaced[[i for t, i in ranks.items() if t.startswith(b" ")]] = True
        self.known: dict[str, bytes] = {}

    def _merged(self, text: str) -> bytes:
        return np.array(self._bpe.encode_ordinary(text), "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        ids = np.array(self._bpe.encode_ordinary(" " + " ".join(chunks)), "<u4")
        at = (np.flatnonzero(self._spaced[ids]) * 4).tolist()
        if len(at) != len(chunks):
            raise ValueError("a chunk does not begin with one spaced token")
        raw = ids.tobytes()
        self.known.update(zip(chunks, (raw[a:b] for a, b in zip(at, [*at[1:], len(raw)]))))

    def all(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | list[str]] = []
        for t in texts:
            if self._OTHER.search(t) or any(s in t for s in self.special):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
            elif "  " in t or " \n" in t or "\n " in t or t.endswith(" ") or "\t" in t or "\r" in t or "\x0b" in t or "\x0c" in t:
                out.append(self._merged(t))
            else:
                out.append(t.split(" "))
        chunked = [x for x in out if isinstance(x, list)]
        new = set().union(*(x[1:] for x in chunked)) - self.known.keys()
        if len(self.known) + len(new) > self.keep:
            self.known.clear()
            new = set().union(*(x[1:] for x in chunked))
        if new:
            self._learn(list(new))
        get = self.known.__getitem__
        return [x if isinstance(x, bytes) else self._merged(x[0]) + b"".join(map(get, x[1:])) for x in out]


@functools.cache
def _encoder(path: str) -> ByteEncoder:
    """One per Python worker, so that what it knows outlives a task."""
    return ByteEncoder(path)


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def _cutter(path: str, tokens: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = _encoder(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        so_far = np.zeros(tokens + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                docs = batch.slice(at, 256)
                rows: list[tuple[int | None, int, int, int, int]] = []
                for doc_id, ids in zip(docs.column(0).to_pylist(), encode.all([t or "" for t in docs.column(1).to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    stop = (n - 1) % tokens + 1  # the first piece takes what full ones leave
                    start = piece = 0
                    while start < n:
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                        start, stop, piece = stop, stop + tokens, piece + 1
                length = np.array([r[3] for r in rows], np.int64)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                nth = np.empty(len(rows), np.int64)
                nth[order] = so_far[ranked] + np.arange(len(rows)) - np.searchsorted(ranked, ranked)
                so_far += np.bincount(length, minlength=tokens + 1)
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(rows), part, np.int32)), pa.array(nth)], names=[c.split()[0] for c in PIECE.split(", ")])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, tokens: int = 1024, end_id: int = 2) -> DataFrame:
    """Documents (doc_id, text) as pieces of at most `tokens` ids, each with its rank among its task's of that length."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cutter(tokenizer_path, tokens, end_id), PIECE)


def _placer(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:]):
                own = order[a:b]
                begins, firsts, offsets = where[int(length[own[0]])]
                run_ = np.searchsorted(begins, rank[own], side="right") - 1
                sequence[own], offset[own] = firsts[run_] + rank[own] - begins[run_], offsets[run_]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_uncut(docs: DataFrame, tokenizer_path: str, tokens: int = 1024, end_id: int = 2, nodes: int = 4_000) -> DataFrame:
    """All documents in as few sequences of at most `tokens` ids as the search finds: one row per piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id (from 0, without gaps) and offset. Documents longer than a
    sequence are cut into full pieces after a first one that takes the rest. A null or empty text is the end id alone;
    repeated rows are documents of their own; a null doc_id stays null; other columns are not read; an empty table
    gives no rows. Pieces are written once (no text among them); counts of at most `tokens` lengths reach the driver, and
    the plan over them, whose size depends on the lengths alone, goes to every task.
    """
    spark = docs.sparkSession
    with scratch() as kept:
        cut = kept.keep(written(pieces(docs, tokenizer_path, tokens, end_id), "pieces"))
        parts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
        counts = np.zeros(tokens + 1, np.int64)
        for row in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length
            counts[row.length] = row.n
        where = spark.sparkContext.broadcast(places(plan(counts, tokens, nodes), tokens))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = cut.join(few(parts.select("part", "length", before.alias("before"))), ["part", "length"])
        thin = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
        return thin.mapInArrow(_placer(where), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
