"""Toxicity by a support vector machine on a gapped-subsequence string kernel.

Two strings are alike by the letter triples they share in order, gaps allowed, each letter a triple spans costing a factor
`decay` (Lodhi et al., 2002): an insult stays near itself when letters are put in, drawn out or set apart. The kernel is
approximated by landmarks (Nystroem), a linear machine with squared hinge is trained on the landmark features, and the
trained machine is folded into one weight per triple, which scores a string exactly as the landmark expansion does.

Only whole documents are labelled. The strings that make a document toxic are found by covering: of strings that clean
documents lack, the one most toxic documents hold, then the one most of the rest hold, and so on. The machine learns
these against strings of clean documents, then relearns with every candidate it agrees to and with the clean strings
that come near. A document has the margins of its three most toxic strings; a logistic fit on labelled documents turns
them into a score.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import crc_fold, scratch, written

ALPHABET = 96  # codes of letters: 0 the start, a-z, digits, Latin-1, and 34 shared by all others
LONGEST, STEP = 24, 8  # a longer string is scored window by window
TOP = 3  # margins of a document
POOLS = ((1.0, 0.0, 0.0), (1.0, 0.25, 0.1), (1.0, 0.5, 0.25), (1.0, 1.0, 0.5))

_PUNCTUATION = re.compile(r"[^\w\s]|_")
_APART = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")


def strings(text: str | None) -> set[str]:
    """The distinct strings of a whole text that are scored: words without punctuation, and runs of single letters joined."""
    clean = _PUNCTUATION.sub("", (text or "").lower())
    found = set(clean.split())
    found.update("".join(m[0].split()) for m in _APART.finditer(clean))
    return found


def codes(word: str) -> list[int]:
    """The word's start (0) and its letters as small numbers: a-z, digits, Latin-1 letters, and what is left of the rest by 34."""
    out = [0]
    for c in word:
        o = ord(c)
        out.append(o - 96 if 97 <= o <= 122 else 27 + (o - 48) // 5 if 48 <= o <= 57 else 29 + o - 0xDF if 0xDF <= o <= 0xFF else 62 + o % 34)
    return out


@functools.cache
def _triples(n: int, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return at[:, 0], at[:, 1], at[:, 2], (decay ** (at[:, 2] - at[:, 0] + 1)).astype(np.float64)


def features(words: list[str], decay: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each word (at most LONGEST letters): its triples and their weights in the kernel's feature space."""
    out = []
    for w in words:
        c = np.array(codes(w), np.int64)
        i, j, k, weight = _triples(len(c), decay)
        u, back = np.unique((c[i] * ALPHABET + c[j]) * ALPHABET + c[k], return_inverse=True)
        out.append((u, np.bincount(back, weight, len(u))))
    return out


def kernel(a: list[str], b: list[str], decay: float) -> np.ndarray:
    """Normalised kernel of two lists of words; 0 where a word has no triple."""
    of_a, of_b = features(a, decay), features(b, decay)
    known = np.unique(np.concatenate([u for u, _ in of_b] or [np.zeros(0, np.int64)]))
    dense = np.zeros((len(known) + 1, len(b)))  # the last row stands for triples that no b has
    for k, (u, v) in enumerate(of_b):
        if len(u):
            dense[np.searchsorted(known, u), k] = v / np.sqrt(v @ v)
    out = np.zeros((len(a), len(b)))
    for row, (u, v) in zip(out, of_a):
        if len(u) and len(known):
            at = np.minimum(np.searchsorted(known, u), len(known) - 1)
            row[:] = (v / np.sqrt(v @ v)) @ dense[np.where(known[at] == u, at, len(known))]
    return out


def windows(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST + STEP, STEP)]


@dataclass
class Machine:
    weights: np.ndarray  # per triple
    bias: float
    decay: float
    slopes: tuple[float, ...] = (4.0, 0.0, 0.0)  # of a document's largest margins
    shift: float = 0.0

    def word_margins(self, words: list[str]) -> np.ndarray:
        """Margins of words of at most LONGEST letters, by length, all words of a length at once."""
        out = np.full(len(words), self.bias)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1  # with the start
        for n in np.unique(lengths):
            if n < 3:
                continue
            at = np.flatnonzero(lengths == n)
            i, j, k, weight = _triples(int(n), self.decay)
            for part in np.array_split(at, max(1, len(at) * len(weight) // 200_000)):
                c = np.array([codes(words[x]) for x in part], np.int64)
                u = (c[:, i] * ALPHABET + c[:, j]) * ALPHABET + c[:, k]
                order = np.argsort(u, axis=1, kind="stable")
                s, v = np.take_along_axis(u, order, 1), weight[order]
                total = np.cumsum(v, axis=1)
                ends = np.concatenate([s[:, 1:] != s[:, :-1], np.ones((len(s), 1), bool)], axis=1)
                # weight of a triple in the word: cumulative sums between the ends of its run
                before = np.maximum.accumulate(np.where(np.concatenate([np.zeros((len(s), 1), bool), ends[:, :-1]], axis=1), np.concatenate([np.zeros((len(s), 1)), total[:, :-1]], axis=1), 0.0), axis=1)
                norm = np.sqrt((np.where(ends, total - before, 0.0) ** 2).sum(1))
                out[part] += (self.weights[u] * weight).sum(1) / norm
        return out


def train(positive: list[str], negative: list[str], decay: float = 0.6, landmarks: int = 256, cost: float = 20.0, seed: int = 5) -> Machine:
    """Squared-hinge machine on Nystroem features, by Newton steps. The first positives, most telling first, are the
    landmarks, with a draw of the negatives; words longer than LONGEST are learnt window by window, as they are scored."""
    rng = np.random.default_rng(seed)
    clean = lambda ws: [w for x in ws for w in windows(x) if len(w) >= 3]
    pos, neg = clean(positive), clean(negative)
    most = landmarks * 3 // 4
    marks = pos[:most] + [neg[i] for i in rng.permutation(len(neg))[: landmarks - most]]
    if not pos or not marks:
        return Machine(np.zeros(ALPHABET**3, np.float32), -1.0, decay)
    values, vectors = np.linalg.eigh(kernel(marks, marks, decay))
    ok = values > 1e-6 * values.max()
    root = vectors[:, ok] / np.sqrt(values[ok])
    x = kernel(pos + neg, marks, decay) @ root
    y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
    c = cost * np.where(y > 0, len(y) / (2 * len(pos)), len(y) / (2 * max(len(neg), 1))) / len(y) * 100
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, ridge = np.zeros(x1.shape[1]), np.append(np.ones(x.shape[1]), 1e-3)
    for _ in range(40):
        on = y * (x1 @ w) < 1
        a = x1[on]
        new = np.linalg.solve((a * c[on, None]).T @ a + np.diag(ridge), a.T @ (c[on] * y[on]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    beta, table = root @ w[:-1], np.zeros(ALPHABET**3)
    for b, (u, v) in zip(beta, features(marks, decay)):
        if len(u):
            table[u] += b * v / np.sqrt(v @ v)
    return Machine(table.astype(np.float32), float(w[-1]), decay)


def cover(pairs: Iterable[tuple[int, str]], times: int = 3, least: int = 2) -> list[str]:
    """Greedy covering of documents by strings, each document up to `times` times; a string must add `least` at least."""
    of: dict[str, set[int]] = {}
    for d, w in pairs:
        of.setdefault(w, set()).add(d)
    need = {d: times for ds in of.values() for d in ds}
    heap = [(-len(ds), w) for w, ds in of.items()]
    heapq.heapify(heap)
    chosen = []
    while heap and -heap[0][0] >= least:
        old, w = heapq.heappop(heap)
        now = -sum(need[d] > 0 for d in of[w])  # never more than when it was put in
        if now != old:
            heapq.heappush(heap, (now, w))
            continue
        chosen.append(w)
        for d in of[w]:
            need[d] -= need[d] > 0
    return chosen


def support(n_toxic: int, n_clean: int, n_strings: int) -> int:
    """Documents that a string must newly cover: so many that of n_strings rare words without meaning, dealt to documents
    at random, one would be found in that many toxic and no clean ones once in a hundred samples. In small samples, where
    no string has so many, one of 50 toxic documents, and two at least."""
    share = n_toxic / max(n_toxic + n_clean, 1)
    test = math.ceil(math.log(100 * max(n_strings, 1)) / -math.log(share)) if 0 < share < 1 else 2
    return max(2, min(test, n_toxic // 50))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
        found = [list(strings(t.as_py())) for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "words"])


def fit(docs: DataFrame, labels: DataFrame, most: int = 4_000, plain: int = 300, folds: int = 5, seed: int = 5) -> Machine:
    """Fit on at most `most` toxic and 2 * `most` clean labelled documents outside fold 0 (the bounds of the sample).

    The sample is that of the smallest hashes of doc_id; contradicting labels of a doc_id leave it out. Of the toxic ones
    every string takes part that two of them hold and that clean ones hardly hold; of the clean ones, all strings of the
    first `plain` documents, and every string of any of them that comes near the boundary. Null, empty and letter-less texts
    hold no strings; rows of a repeated doc_id are documents of their own; empty tables, or no toxic document, give a
    machine under which every document scores low. Only doc_id, text and toxic are read.
    """
    with scratch():
        return _fit(docs, labels, most, plain, folds, seed)


def _fit(docs: DataFrame, labels: DataFrame, most: int, plain: int, folds: int, seed: int) -> Machine:
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_fold(F.col("doc_id"), folds) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).where("lo = hi")
    pick = lambda v, n: own.where(F.col("lo") == v).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n)
    chosen = pick(1, most).unionAll(pick(0, 2 * most)).select("doc_id", F.col("lo").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")  # at most 3 * most ids
    words = texts.mapInArrow(_strings, "doc_id bigint, toxic int, words array<string>").select("doc_id", "toxic", F.explode("words").alias("w")).where(F.char_length("w") >= 3)
    words = written(words, "toxic-words")
    counts = written(words.groupBy("w").agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0")), "toxic-counts")
    candidates = counts.where("n1 >= 2 and n1 >= 40 * n0").select("w")
    pairs = words.where("toxic = 1").join(candidates, "w").select("doc_id", "w").toPandas()
    first = words.where("toxic = 0").select("doc_id").distinct().orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").limit(plain)
    clean = sorted({r.w for r in words.where("toxic = 0").join(F.broadcast(first), "doc_id").select("w").distinct().collect()})  # `plain` ids
    n_toxic, n_clean, n_strings = chosen.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()[:2] + (counts.count(),)
    seeds = cover(zip(pairs.doc_id, pairs.w), least=support(n_toxic, n_clean, n_strings))
    if not seeds:
        return Machine(np.zeros(ALPHABET**3, np.float32), -1.0, 0.6)
    machine = train(seeds, clean, seed=seed)
    rest = sorted(set(pairs.w))
    agreed = {w for w, m in zip(rest, margins_of(machine, rest)) if m > 0}
    positive = seeds + sorted(agreed - set(seeds))
    for _ in range(2):  # clean strings that come near the boundary are learnt from too
        machine = train(positive, clean, seed=seed)
        near = counts.where("n0 > 0").select("w", F.col("w").alias("t")).mapInArrow(_margins(machine), "w string, margins array<double>").where(F.col("margins")[0] > -0.5).select("w")
        clean = sorted({*clean, *(r.w for r in near.collect())} - set(seeds))
    machine = train(positive, clean, seed=seed)
    got = texts.mapInArrow(_margins(machine), "doc_id bigint, toxic int, margins array<double>").toPandas().sort_values("doc_id", kind="stable")
    machine.slopes, machine.shift = _logistic(np.array(got.margins.tolist(), float).reshape(-1, TOP), got.toxic.to_numpy(float))
    return machine


def _cut(z: np.ndarray, y: np.ndarray) -> tuple[int, float]:
    """Errors at the best cut of z, and the middle of the widest gap among such cuts."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    least = errors[np.diff(edges) > 0].min()
    k = int(np.argmax(np.where(errors == least, np.diff(edges), 0.0)))
    return int(least), float(edges[k] + edges[k + 1]) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and shift: of a few fixed ways to pool the margins the one with the fewest errors (the first of equals),
    scaled by a ridge logistic fit and shifted so that 0.5 lies at its cut."""
    least, cut, pool = min(((*_cut(x @ np.array(p), y), p) for p in POOLS), key=lambda t: t[0])
    z, w = x @ np.array(pool), np.array([1.0, 0.0])
    a = np.stack([z - cut, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-1 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, a.T @ (y - p) - 1e-1 * w), -5, 5)
    slope = float(w[0]) if w[0] > 0 else 4.0
    return tuple(slope * v for v in pool), -slope * cut


def margins_of(machine: Machine, words: list[str]) -> list[float]:
    """Margins of words of any length: of long ones the largest of their windows."""
    short = [w for w in words if len(w) <= LONGEST]
    known = dict(zip(short, machine.word_margins(short).tolist()))
    return [known[w] if w in known else float(machine.word_margins(windows(w)).max()) for w in words]


def _margins(machine: Machine, keep: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            k = batch.num_columns - 1
            sets: list[set[str]] = [strings(t.as_py()) for t in batch.column(k)]
            new = [w for w in set().union(*sets) - known.keys()]
            if len(known) + len(new) > keep:
                known.clear()
                new = list(set().union(*sets))
            known.update(zip(new, margins_of(machine, new)))
            out = [(heapq.nlargest(TOP, map(known.__getitem__, s)) + [machine.bias] * TOP)[:TOP] for s in sets]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names[:k], "margins"])

    return run


def score(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep + score (0 to 1): one row per row of docs, whole texts, no shuffle.

    Null, empty and letter-less texts have the machine's bias as their margin. Scores depend on the text alone.
    """
    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep] + ["margins array<double>"])
    got = docs.select(*[F.col(k) for k in keep], F.col("text").cast("string").alias("__text")).mapInArrow(_margins(machine), schema)
    z = sum((F.col("margins")[i] * w for i, w in enumerate(machine.slopes)), F.lit(float(machine.shift)))
    return got.select(*keep, (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))).alias("score"))
