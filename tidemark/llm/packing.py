"""Vector bin packing of token sequences.

An example needs three things of a sequence at once: tokens, a segment, and loss-bearing tokens. Into the open sequence
goes the example whose needs have the largest dot product with what is left of the limits, among those that fit; that is
the one that uses up what is plentiful. Where cutting is allowed, the gap that no example fits is filled with the front
of one, so that a sequence closes full.

Each task packs what it reads, block by block, and hands the unfinished sequence on to the next block: no shuffle, no
global state, and memory bounded by the block and the longest single text. A task's very last tokens go out in
sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Of one sequence. tokens is a power of two."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


@dataclass
class Items:
    """Pieces that wait: owner (index of the example), start in it, length, loss-bearing tokens."""

    owner: np.ndarray
    start: np.ndarray
    length: np.ndarray
    loss: np.ndarray


@dataclass
class Placed:
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # owner, start, length, sequence, offset


def pack_block(items: Items, limits: Limits, cut: bool, last: bool, sequence: int) -> tuple[Placed, list[tuple[int, int, int, int]], int]:
    """Pack a block; returns the placements, the pieces of the unfinished sequence (none if last) and the next number.

    With cut, pieces may be cut anywhere (their loss-bearing tokens are taken to be spread evenly) and a sequence is
    closed at the largest length that needs no padding. Without, a piece over the limits has a sequence of its own.
    """
    out, waiting = Placed(), []
    total = np.array([limits.tokens, limits.segments, limits.loss], float)
    order = np.argsort(-items.length, kind="stable")
    owner, start, length, loss = (x[order].copy() for x in (items.owner, items.start, items.length, items.loss))
    if cut:  # whole sequences first
        for i in np.flatnonzero((length >= limits.tokens) & (loss <= length)):
            per = min(limits.tokens, max(1, int(limits.loss * length[i] // max(loss[i], 1))))
            while per == limits.tokens and length[i] >= per:
                out.rows.append((owner[i], start[i], per, sequence, 0))
                share = int(loss[i] * per // length[i])
                start[i], length[i], loss[i], sequence = start[i] + per, length[i] - per, loss[i] - share, sequence + 1
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        owner, start, length, loss = owner[order], start[order], length[order], loss[order]
    alive = np.ones(len(owner), bool)
    n_left, first = len(owner), 0
    plain = bool((loss == length).all())  # then the dot product grows with the length, and the order above is its order
    while n_left:
        room, bin_ = total.copy(), []
        while n_left:
            while first < len(alive) and not alive[first]:
                first += 1
            if room[1] < 1:
                break
            if plain:
                i = first + int(np.searchsorted(-length[first:], -min(room[0], room[2]), side="left"))
                while i < len(alive) and not alive[i]:
                    i += 1
                fits = i < len(alive)
            else:
                live = np.flatnonzero(alive[first:]) + first
                ok = live[(length[live] <= room[0]) & (loss[live] <= room[2])]
                fits = len(ok) > 0
                if fits:
                    score = length[ok] / total[0] * room[0] / total[0] + room[1] / total[1] / total[1] + loss[ok] / total[2] * room[2] / total[2]
                    i = int(ok[np.argmax(score)])
            if fits:
                bin_.append((int(owner[i]), int(start[i]), int(length[i]), int(loss[i])))
                alive[i] = False
                n_left -= 1
                room -= (length[i], 1, loss[i])
            elif cut and room[0] >= 1 and room[2] >= 1:
                i = first
                part = int(min(room[0], max(1, room[2] * length[i] // max(loss[i], 1))))
                share = int(loss[i] * part // length[i])
                bin_.append((int(owner[i]), int(start[i]), part, share))
                rest = (owner[i], start[i] + part, length[i] - part, loss[i] - share)
                alive[i] = False
                at = int(np.searchsorted(-length, -rest[2], side="left"))
                owner, start, length, loss, alive = (np.insert(x, at, v) for x, v in zip((owner, start, length, loss, alive), (*rest, True)))
                first = min(first, at)
                room -= (part, 1, share)
            else:
                if not bin_:  # over the limits by itself
                    bin_.append((int(owner[first]), int(start[first]), int(length[first]), int(loss[first])))
                    alive[first] = False
                    n_left -= 1
                break
        used = sum(p[2] for p in bin_)
        if used < limits.tokens and not n_left and not last:
            waiting = bin_
            break
        sequence = _close(out, bin_, used, limits, cut, sequence)
    return out, waiting, sequence


def _close(out: Placed, bin_: list[tuple[int, int, int, int]], used: int, limits: Limits, cut: bool, sequence: int) -> int:
    """Number the pieces of one sequence; with cut, a short one is split at power-of-two lengths."""
    sizes = [used] if not cut or used >= limits.tokens else [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
    room, offset = sizes.pop(0), 0
    for owner, start, length, _ in bin_:
        if not length:
            out.rows.append((owner, start, 0, sequence, offset))
        while length:
            part = min(length, room - offset)
            out.rows.append((owner, start, part, sequence, offset))
            start, length, offset = start + part, length - part, offset + part
            if offset == room and sizes:
                room, offset, sequence = sizes.pop(0), 0, sequence + 1
    return sequence + 1


class WordEncoder:
    """Ids of texts by a word-splitting byte-level BPE file with word ends, as little-endian uint32 bytes.

    The tokenizer lower-cases and never joins across white space, so the ids of a text are those of its words, and the
    words' ids are kept (at most `keep` of them, then afresh). New words of lower-case Latin-1 letters are merged in one
    call by a rank-based BPE that holds the same vocabulary: each letter's bytes, and each last letter as a byte of its
    own, stand for the file's base symbols. Only vocabulary entries that the tokenizer itself makes of their own letters
    are given to it, which is what makes merging by rank equal to merging by the file's list. Everything else goes to the
    tokenizer: pieces with other characters, and whole texts with characters for which lower-casing or splitting could
    differ, or with its special strings.
    """

    _SAFE = regex.compile(r"[^\x09-\x0D\x20-\x7E\xA1-\xAC\xAE-\u024F]|<\|")
    _SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    _LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, (*range(0xDF, 0xF7), *range(0xF8, 0x100))))
    _PLAIN = regex.compile(f"[{_LETTERS}]+")
    _END = "</w>"

    def __init__(self, path: str, keep: int = 300_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.known: dict[str, bytes] = {}
        # base symbols: the file spells byte b as one character; here a byte inside a word is b, a last byte has bit 7 and
        # bit 6 arranged so that all stay apart: inside a-z 0x61-7A, 0xC3, 0x9F-BF; last a-z 0x01-1A, 0xDF-FF
        self._last = {**{c: c - 0x60 for c in range(0x61, 0x7B)}, **{c: c + 0x40 for c in range(0x9F, 0xC0)}}
        inside = {c: c for c in (*range(0x61, 0x7B), 0xC3, *range(0x9F, 0xC0))}
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        spelt = {chr(b if b in printable else next(others)): b for b in range(256)}
        ranks, vocabulary = {}, self.tokenizer.get_vocab()
        for token, i in vocabulary.items():
            body, end = token.removesuffix(self._END), token.endswith(self._END)
            codes = [spelt.get(c, 0) for c in body]
            if not codes or any(c not in inside for c in codes) or end and codes[-1] not in self._last:
                continue
            made = self.tokenizer.model.tokenize(body) if end else None
            if end and len(codes) > 1 and [t.id for t in made] != [i]:
                continue
            ranks[bytes([*codes[:-1], self._last[codes[-1]] if end else codes[-1]])] = i
        self.size = len(vocabulary)
        spare = iter(range(1 << 20, 1 << 21))
        for b in range(256):
            ranks.setdefault(bytes([b]), next(spare))
        self._ends = np.zeros(self.size, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith(self._END)]] = True
        self._ranks = tiktoken.Encoding("words", pat_str=r"[^ ]+", mergeable_ranks=ranks, special_tokens={})

    def _learn(self, words: list[str]) -> None:
        """Ids of new pieces of lower-case Latin-1 letters, all in one call."""
        raw, last = [w.encode() for w in words], self._last
        marked = b" ".join([r[:-1] + bytes((last[r[-1]],)) for r in raw])
        core = self._ranks._core_bpe
        flat = np.array([i for w in marked.split(b" ") for i in core.encode_single_piece(w)], "<u4")
        ends = (np.flatnonzero(self._ends[flat]) + 1) * 4
        ids = flat.tobytes()
        if len(ends) != len(words):
            raise ValueError("a word has no end token")
        self.known.update(zip(words, (ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))))

    def learn(self, words: set[str]) -> None:
        known, plain = self.known, self._PLAIN.fullmatch
        whole = {w for w in words if plain(w)}
        split = {w: self._SPLIT.findall(w) for w in words - whole}
        pieces = {p for ps in split.values() for p in ps if p not in known}
        letters = {p for p in pieces if plain(p)}
        if new := list(whole | letters):
            self._learn(new)
        for p in pieces - letters:
            known[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes()
        for w, ps in split.items():
            known[w] = b"".join(map(known.__getitem__, ps))

    def __call__(self, text: str) -> bytes:
        return self.all([text])[0]

    def all(self, texts: list[str]) -> list[bytes]:
        safe = [not self._SAFE.search(t) for t in texts]
        words = [t.lower().split() if s else [] for t, s in zip(texts, safe)]
        new = set().union(*words) - self.known.keys()
        if len(self.known) + len(new) > self.keep:
            self.known.clear()
            new = set().union(*words)
        self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, w)) if s else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, s, w in zip(texts, safe, words)]


@functools.cache
def _encoder(path: str) -> WordEncoder:
    """One per Python worker, so that what it knows outlives a task."""
    return WordEncoder(path)


PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _packer(path: str, limits: Limits, end_id: int, block_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(path), np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        docs: list[tuple[int | None, bytes]] = []
        waiting: list[tuple[int, int, int, int]] = []
        sequence = tokens = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal docs, waiting, sequence, tokens
            fresh = range(n_old, len(docs))
            pieces = waiting + [(i, 0, len(docs[i][1]) // 4, len(docs[i][1]) // 4) for i in fresh]
            cols = [np.array(x, np.int64) for x in zip(*pieces)] if pieces else [np.zeros(0, np.int64)] * 4
            placed, rest, sequence = pack_block(Items(*cols), limits, True, last, sequence)
            rows = [(docs[o][0], s, n, zlib.crc32(docs[o][1][4 * s : 4 * (s + n)]), len(docs[o][1]) // 4, base + q, at) for o, s, n, q, at in ((int(o), int(s), int(n), q, at) for o, s, n, q, at in placed.rows)]
            keep = {o: k for k, o in enumerate(dict.fromkeys(r[0] for r in rest))}
            docs, waiting, tokens = [docs[o] for o in keep], [(keep[o], s, n, x) for o, s, n, x in rest], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], names=[c.split()[0] for c in PIECE.split(", ")])

        n_old = 0
        for batch in batches:
          for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc_id, ids in zip(part.column(0).to_pylist(), encode.all([t or "" for t in part.column(1).to_pylist()])):
                docs.append((doc_id, ids + end))
                ids = docs[-1][1]
                tokens += len(ids) // 4
                if tokens >= block_tokens:
                    yield flush(False)
                    n_old = len(docs)
        yield flush(True)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 2, block_tokens: int = 2_000_000) -> DataFrame:
    """Pack whole documents (doc_id, text), cut freely: one row per piece, columns of PIECE.

    A null or empty text is the end id alone. Every id lies in exactly one piece; sequences are gapless from offset 0 and
    hold at most limits.tokens; shorter ones have power-of-two lengths and need no padding. sequence_id
    is the task's number and a count in it. Repeated rows are packed each for itself; a null doc_id stays null; an
    empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_packer(tokenizer_path, limits, end_id, block_tokens), PIECE)


def _whole(limits: Limits, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sequence = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                n, loss = (np.maximum(np.nan_to_num(part.column(k).to_numpy(zero_copy_only=False).astype(float)), 0).astype(np.int64) for k in (1, 2))
                placed, _, sequence = pack_block(Items(np.arange(len(n)), np.zeros(len(n), np.int64), n, loss), limits, False, True, sequence)
                of = np.array([r[0] for r in placed.rows], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of)), pa.array(n[of]), pa.array(loss[of]), pa.array(np.array([base + r[3] for r in placed.rows], np.int64)), pa.array(np.array([r[4] for r in placed.rows], np.int64))],
                    names=["example_id", "n_tokens", "n_loss", "sequence_id", "offset"],
                )

    return run


def pack_examples(examples: DataFrame, limits: Limits = Limits(), block: int = 4096) -> DataFrame:
    """Place uncut instruction examples (example_id, n_tokens, n_loss) under all three limits at once.

    Returns example_id, n_tokens, n_loss, sequence_id, offset. An example over a limit has a sequence of its own. Null or
    negative counts are 0; an example without tokens is still placed if it has a row. Empty tables give no rows.
    """
    rows = examples.select("example_id", F.col("n_tokens").cast("double"), F.col("n_loss").cast("double"))
    kind = examples.schema["example_id"].dataType.simpleString()
    return rows.mapInArrow(_whole(limits, block), f"example_id {kind}, n_tokens bigint, n_loss bigint, sequence_id bigint, offset bigint")


def _counted(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = [len(ids) // 4 + 1 for ids in encode.all([t or "" for t in part.column(2).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["example_id", "bears_loss", "n"])

    return run


def instruction_examples(conversations: DataFrame, tokenizer_path: str, learnt: str = "assistant") -> DataFrame:
    """example_id, n_tokens, n_loss of each conversation (conv_id, role, text): a turn is its ids and an end id, and those of the
    role `learnt` bear loss. A null text is the end id alone, a null role bears none, a null conv_id is an example too."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.coalesce(F.col("role") == learnt, F.lit(False)), F.col("text").cast("string"))
    counted = rows.mapInArrow(_counted(tokenizer_path), "example_id bigint, bears_loss boolean, n bigint")
    return counted.groupBy("example_id").agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("bears_loss"), F.col("n")).otherwise(0)).alias("n_loss"))
