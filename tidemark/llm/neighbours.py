"""Approximate nearest neighbours by collision counting (query-aware hashing; Huang et al., 2015).

A hash function is one random projection. Vectors are kept sorted along each of them. A query puts its own projection in
the middle of a window of each sorted array; a vector collides wherever it lies in the window. Windows widen by virtual
rehashing, radius by radius, and only what newly enters is counted. A vector that has collided often enough for the
radius is verified by its exact cosine. A query ends at the first radius within which it has its k nearest: a vector
inside that radius passes the collision threshold with probability 1 - miss, so that is also the recall to expect.

Rows are dealt into blocks. A block's sorted arrays are built once, where its rows meet, and the queries stream past them
batch by batch; each leaves its k best of the block, and a second step merges these. Nothing is broadcast, no task holds
more than a block and a batch of queries, and no number of candidates is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import written


@dataclass(frozen=True)
class Hashing:
    """projections: hash functions; width: of a window, in radii; ratio: of successive radii; miss: chance to overlook
    a vector inside the radius; first: smallest radius (Euclidean, between unit vectors)."""

    projections: int = 160
    width: float = 2.0
    ratio: float = 1.2
    miss: float = 0.15
    first: float = 0.31
    seed: int = 11

    def threshold(self) -> int:
        p = 2 * NormalDist().cdf(self.width / 2) - 1  # a vector at the radius collides with this probability
        m = self.projections
        return max(1, math.floor(m * p + NormalDist().inv_cdf(self.miss) * math.sqrt(m * p * (1 - p))))


class SortedProjections:
    """The index of a block of vectors."""

    def __init__(self, unit: np.ndarray, hashing: Hashing):
        self.unit, self.hashing = unit, hashing
        self.lines = np.random.default_rng(hashing.seed).normal(size=(hashing.projections, unit.shape[1]))
        flat = self.lines @ unit.T
        self.order = np.argsort(flat, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(flat, self.order, axis=1)

    def search(self, q: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and squared distances of the k nearest found (more on ties); skip: a row that is no candidate."""
        h, n, m = self.hashing, len(self.unit), self.hashing.projections
        centre, need = self.lines @ q, self.hashing.threshold()
        radii = h.first * h.ratio ** np.arange(math.ceil(math.log(2.5 / h.first) / math.log(h.ratio)) + 1)  # no two unit vectors lie farther apart
        halves = h.width * radii / 2
        below = [np.searchsorted(line, c - halves, "left") for line, c in zip(self.sorted, centre)]  # windows of all radii at once
        above = [np.searchsorted(line, c + halves, "right") for line, c in zip(self.sorted, centre)]
        lo = hi = [np.searchsorted(line, c) for line, c in zip(self.sorted, centre)]
        count = np.zeros(n, np.int16)
        verified = np.zeros(n, bool)
        rows, dist = np.zeros(0, np.int64), np.zeros(0)
        if skip >= 0:
            verified[skip] = True
        left = n - (skip >= 0)
        for step, radius in enumerate(radii):
            fresh = []
            now_lo, now_hi = [w[step] for w in below], [w[step] for w in above]
            for j in range(m):
                fresh += [self.order[j, now_lo[j] : lo[j]], self.order[j, hi[j] : now_hi[j]]]
            lo, hi = now_lo, now_hi
            got = np.concatenate(fresh)
            if len(got):
                count += np.bincount(got, minlength=n).astype(np.int16)
                new = np.flatnonzero((count >= need) & ~verified)
                if len(new):
                    verified[new] = True
                    left -= len(new)
                    gap = self.unit[new] - q
                    rows, dist = np.concatenate([rows, new]), np.concatenate([dist, np.einsum("ij,ij->i", gap, gap)])
                    if len(rows) > 4 * k:
                        bar = np.partition(dist, k - 1)[k - 1]
                        rows, dist = rows[dist <= bar + 1e-12], dist[dist <= bar + 1e-12]
            if (dist <= radius * radius).sum() >= k or left <= 0:
                return rows, dist
        new = np.flatnonzero(~verified)  # fewer than k within any distance: the rest needs no window
        gap = self.unit[new] - q
        return np.concatenate([rows, new]), np.concatenate([dist, np.einsum("ij,ij->i", gap, gap)])


def _valid(vector: Column) -> Column:
    v = vector.cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vector.isNotNull() & F.coalesce(ok, F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, also where lengths over- or underflow."""
    size = np.linalg.norm(x, axis=1)
    odd = ~np.isfinite(size) | (size < 1e-150)
    if odd.any():
        x = np.where(odd[:, None], x / np.abs(x).max(axis=1)[:, None], x)
        size = np.linalg.norm(x, axis=1)
    return x / size[:, None]


class Block:
    """The vectors of a block, an index for each vector length, and the place of every row."""

    def __init__(self, ids: list[int], rows: list[int], vectors: list[np.ndarray], hashing: Hashing):
        self.of: dict[int, tuple[np.ndarray, np.ndarray, SortedProjections]] = {}
        self.place = {r: i for i, r in enumerate(rows)}
        lengths = np.array([len(v) for v in vectors])
        self.within = np.zeros(len(ids), np.int64)
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            self.within[at] = np.arange(len(at))
            x = np.stack([vectors[i] for i in at])
            self.of[int(d)] = (np.array(ids, np.int64)[at], x, SortedProjections(_unit(x), hashing))

    def nearest(self, row: int, a: np.ndarray, k: int) -> list[tuple[int, float]]:
        """Ids and scores of the k nearest found; the row itself is none of them."""
        if len(a) not in self.of:
            return []
        ids, x, index = self.of[len(a)]
        own = int(self.within[self.place[row]]) if row in self.place else -1
        q = _unit(a[None])[0]
        near, _ = index.search(q, k, own)
        b = x[near]
        with np.errstate(all="ignore"):
            s = (b @ a) / (np.sqrt((b * b).sum(1)) * math.sqrt(float(a @ a)))
        s = np.where(np.isfinite(s), s, index.unit[near] @ q)
        best = np.lexsort((ids[near], -s))[:k]
        return [(int(ids[near[i]]), float(s[i])) for i in best]


def _block_search(hashing: Hashing, k: int):
    """Sorted (block, asks, id, row, v): of each block first its rows, then the queries -> (query_id, query_row, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        ids, rows, vectors = [], [], []
        for batch in batches:
            found: list[tuple[int, int, int, float]] = []
            flat, ends = batch.column(4).values.to_numpy(zero_copy_only=False), batch.column(4).offsets.to_numpy()
            for i, (b, asks, id_, row) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if b != now:
                    now, block, ids, rows, vectors = b, None, [], [], []
                v = flat[ends[i] : ends[i + 1]]
                if not asks:
                    ids.append(id_), rows.append(row), vectors.append(np.array(v, float))
                    continue
                if block is None:
                    block, vectors = Block(ids, rows, vectors, hashing), []
                found += [(id_, row, other, score) for other, score in block.nearest(row, np.asarray(v, float), k)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 4, [pa.int64()] * 3 + [pa.float64()])], names=["query_id", "query_row", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 5, hashing: Hashing = Hashing(), rows_per_block: int = 20_000, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, query_row, rank, vec_id, score): the k nearest rows by cosine of every row for which `queries` holds.

    Nearest first, ties to the smaller id. Vectors that are null, zero or hold null or non-finite components take no part, as
    queries or as candidates; neither do rows with a null id. Vectors meet only vectors of their own length. A repeated id
    is a row of its own (query_row tells repeated queries apart); only the query's own row is no candidate. Fewer than k
    candidates give fewer rows; an empty table none. Other columns are read only where `queries` names them.
    """
    good = vectors.where(_valid(F.col(vector)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, vector).alias("row"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q")
    )
    good = written(good.withColumn("row", F.col("row").bitwiseXOR(F.xxhash64(F.monotonically_increasing_id()))), "ann-vectors")
    blocks = max(1, math.ceil(good.count() / rows_per_block))
    rows = good.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "row", "v")
    asked = good.where("q").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "id", "row", "v")
    met = rows.unionAll(asked).repartition("block").sortWithinPartitions("block", "asks")
    parts = met.mapInArrow(_block_search(hashing, k), "query_id bigint, query_row bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return parts.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "query_row", "rank", "vec_id", "score")
