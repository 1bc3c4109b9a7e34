"""How far the sources of a language differ in their words, and by which words.

Terms are integers here: the kept terms of a language lie in sorted arrays, searchsorted gives a term's id and a bincount
over ids is a group's vector. A language's terms are dealt by hash into chunks of about equal work, each chunk with an array
of its own; ids follow the UTF-8 order of the terms, so within a chunk equal values are ordered by id. All numbers are
exact integers.

Texts meet no shuffle: tasks count terms per group where the texts lie, and only distinct (language, source, term) travel.
A group with a large share of all texts is as many rows as it has terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import few, scratch, written

SCALE = 1_000_000_000
_UPPER = bytes(range(0x41, 0x5B))
#: Bytes of a term stay (ASCII letters, in lower case, and all bytes of other characters); the rest become spaces.
_FOLD = bytes(b if b > 0x7F or 0x61 <= b <= 0x7A else b + 32 if b in _UPPER else 0x20 for b in range(256))


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * count / total) for 0 <= count <= total < 9 * 10**15, without leaving 64 bits."""
    whole, rest = np.divmod(np.asarray(count, np.int64), total)
    for _ in range(3):  # three digits at a time
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _counter(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = [b"", *n]  # the empty term says that the group is there
                cols = [pa.array([lang]).take(pa.array(np.zeros(len(terms), int))), pa.array([source]).take(pa.array(np.zeros(len(terms), int))), pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for lang, source, raw in zip(*(part.column(k).to_pylist() for k in range(3))):
                    n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                    terms = raw.translate(_FOLD).split()
                    n.update(terms)
                    docs.update(set(terms))
                if sum(len(n) for n, _ in held.values()) > most:
                    yield from flush()
        yield from flush()

    return run


def term_counts(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with it); one row with an empty term for each group.

    A task sends its counts on when it holds more than `most`.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    thin = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], text.alias("text"))
    found = thin.mapInArrow(_counter(most), COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


ENCODED = "lang string, chunk bigint, source string, m bigint, n bigint, ids array<int>, counts array<bigint>, totals array<bigint>, terms array<string>"


def _encoder(least: int) -> Callable[[pa.Table], pa.Table]:
    schema = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("source", pa.string()), ("m", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64())), ("terms", pa.list_(pa.string()))])

    def run(rows: pa.Table) -> pa.Table:
        term, source = (rows.column(c).combine_chunks().dictionary_encode() for c in ("term", "source"))
        term, source = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (term, source))
        n, docs = rows.column("n").to_numpy(), rows.column("docs").to_numpy()
        known = np.array([*map(str.encode, term.dictionary.to_pylist()), None], object)[:-1]
        code = term.indices.to_numpy()
        kept = np.sort(known[np.bincount(code, docs, len(known)) >= least])
        at = np.searchsorted(kept, known)
        there = np.array([i < len(kept) and kept[i] == t for i, t in zip(at, known)], bool)
        stays = there[code]
        ids, n, src = at[code][stays], n[stays], source.indices.to_numpy()[stays]
        totals = np.bincount(ids, n, len(kept)).astype(np.int64)
        lang, chunk = rows.column("lang")[0].as_py(), rows.column("chunk")[0].as_py()
        out = [{"lang": lang, "chunk": chunk, "source": None, "m": len(kept), "n": int(totals.sum()), "ids": [], "counts": [], "totals": [], "terms": []}]
        order = np.argsort(src, kind="stable")
        edges = np.flatnonzero(np.diff(src[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            own = order[a:b]
            vector = np.bincount(ids[own], n[own], len(kept)).astype(np.int64)
            has = np.flatnonzero(vector)
            out.append({"lang": lang, "chunk": chunk, "source": source.dictionary[int(src[own[0]])].as_py(), "m": len(kept), "n": int(vector.sum()), "ids": has.tolist(), "counts": vector[has].tolist(), "totals": totals[has].tolist(), "terms": [t.decode() for t in kept[has]]})
        return pa.Table.from_pylist(out, schema)

    return run


def encode(counts: DataFrame, chunks: DataFrame, least: int = 10) -> DataFrame:
    """Vectors over kept terms, one row for each chunk and group with one of its terms: ids and counts, and the
    language's totals and the terms at those ids. A row without a source has the chunk's number of kept terms and the
    language's total in it.

    chunks: lang, n_chunks. A term's rows of all groups meet in one chunk, where it is kept if `least` documents have it.
    """
    dealt = counts.where("term <> ''").join(few(chunks), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("n_chunks")))
    return dealt.select("lang", "chunk", "source", "term", "n", "docs").groupBy("lang", "chunk").applyInArrow(_encoder(least), ENCODED)


def _tile(rows: pa.Table) -> pa.Table:
    """Sums of distances over one chunk, for the pairs of groups that meet in a tile of two blocks of groups."""
    m, v = rows.column("m")[0].as_py() or 0, rows.column("v")[0].as_py()
    names, block = rows.column("source").to_pylist(), rows.column("block").to_numpy()
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    p = np.zeros((len(names), m), np.int64)
    for k, i in enumerate(order):
        c = np.zeros(m, np.int64)
        if (ids := rows.column("ids")[i].values) is not None:
            c[ids.to_numpy()] = rows.column("counts")[i].values.to_numpy()
        if m:
            p[k] = shares(c + 2, rows.column("own")[i].as_py() + 2 * v)
    names, block = [names[i] for i in order], block[order]
    cross = rows.column("a")[0].as_py() != rows.column("b")[0].as_py()
    x, y, value = [], [], []
    for i in range(len(names) - 1):
        others = np.flatnonzero(block[i + 1 :] != block[i]) + i + 1 if cross else np.arange(i + 1, len(names))
        x += [names[i]] * len(others)
        y += [names[j] for j in others]
        value += distance(p[i], p[others]).sum(1).tolist()
    return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()] * len(x), pa.string()), "x": pa.array(x, pa.string()), "y": pa.array(y, pa.string()), "value": pa.array(value, pa.int64())})


def pair_distances(groups: DataFrame, encoded: DataFrame, block: int = 64) -> DataFrame:
    """lang, source, item (another source of the language), value: both ways round.

    groups: lang, source, own (N), v (V), n_chunks. Groups are dealt into blocks of about `block`; a task sees one chunk of
    two blocks, as dense vectors: a term that neither group has counts too.
    """
    n = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = groups.join(few(n), "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    frame = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)))
    sizes = encoded.where("source IS NULL").select("lang", "chunk", "m")
    rows = frame.join(encoded.where("source IS NOT NULL").select("lang", "chunk", "source", "ids", "counts"), ["lang", "chunk", "source"], "left").join(few(sizes), ["lang", "chunk"], "left")
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("a"), F.greatest("block", o).alias("b")))
    tiles = rows.select("lang", "chunk", "source", "own", "v", "m", "ids", "counts", "block", F.inline(meet))
    sums = tiles.groupBy("lang", "chunk", "a", "b").applyInArrow(_tile, "lang string, x string, y string, value bigint").groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    side = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("item"))
    return sums.select("lang", "value", F.inline(F.array(side("x", "y"), side("y", "x")))).select("lang", "source", "item", "value")


def _telling(top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for r in batch.to_pylist():
                p = shares(np.array(r["counts"], np.int64) + 2, r["own"] + 2 * r["v"])
                q = shares(np.array(r["totals"], np.int64) + 2, r["whole"] + 2 * r["v"])
                more = np.flatnonzero(p > q)
                value = distance(p[more], q[more])
                best = np.argsort(-value, kind="stable")[:top]  # terms lie in UTF-8 order
                for col, add in zip(out, ([r["lang"]] * len(best), [r["source"]] * len(best), [r["terms"][k] for k in more[best]], value[best].tolist())):
                    col.extend(add)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "item", "value"])

    return run


def telling_terms(groups: DataFrame, encoded: DataFrame, top: int = 10) -> DataFrame:
    """lang, source, item, value: at most `top` candidates a chunk and group among terms that the group has more of than
    its language. groups: lang, source, own, whole (the language's N), v."""
    rows = encoded.where("source IS NOT NULL").select("lang", "source", "counts", "totals", "terms").join(few(groups.select("lang", "source", "own", "whole", "v")), ["lang", "source"])
    return rows.mapInArrow(_telling(top), "lang string, source string, item string, value bigint")


def audit(docs: DataFrame, least: int = 10, top: int = 10, per_chunk: int = 20_000) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank of documents (text, lang, source).

    Null text, lang and source are empty strings; every row is a document, repeated ones too; other columns are not read;
    an empty table gives no rows. A language of one source has no pairs; without kept terms all its pairs have value 0 and
    it has no terms. A chunk is made for each `per_chunk` counts of a language.
    """
    with scratch() as kept:
        counts = kept.keep(written(term_counts(docs), "counts"))
        chunks = counts.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / per_chunk).alias("n_chunks"))
        encoded = kept.keep(written(encode(counts, chunks, least), "encoded"))
    langs = encoded.where("source IS NULL").groupBy("lang").agg(F.sum("m").alias("v"), F.sum("n").alias("whole"))
    own = encoded.where("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(few(chunks), "lang").join(few(langs), "lang", "left")
    groups = groups.select("lang", "source", "n_chunks", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("own", "v", "whole")])
    parts = pair_distances(groups, encoded).withColumn("part", F.lit("pair")).unionByName(telling_terms(groups, encoded, top).withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return parts.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
