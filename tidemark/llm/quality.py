"""A quality classifier from positive and unlabelled texts.

Only trusted positives carry a label; web text without one is a mixture with an unknown share of good texts. That share
(the class prior) is estimated first, from how a plain positive-against-unlabelled fit ranks both. Then a small network
minimises the non-negative unbiased risk (Kiryo et al., 2017): the loss of positives as positives, plus that of
unlabelled texts as negatives less what positives among them would cost, where this last difference, which is a risk,
is not let below zero: a step that would push it there goes the other way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import crc_fold
from .rules import measure_text

FEATURES = (
    "log_words", "mean_length", "symbols", "dup_lines", "repeated", "upper", "digits", "distinct", "top_word",
    "exclamations", "punctuation", "words_per_line", "long_words", "no_words",
)


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; each is finite, and a null or empty text has only no_words set."""
    n, chars, symbols, dup, repeated, lines, upper, lower, digits, distinct = measure_text(text)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    words = text.encode("utf-8", "surrogatepass").split()
    top = Counter(words).most_common(1)[0][1]
    marks = sum(map(text.count, ".,;:?!'\"()-"))
    return [
        float(np.log1p(n)), min(chars / n, 30.0), min(symbols / n, 2.0), dup / max(lines, 1), repeated / n, upper / max(upper + lower, 1), digits / chars, distinct / n,
        top / n, min(text.count("!") / n, 2.0), min(marks / n, 2.0), float(np.log1p(n / max(lines, 1))), sum(len(w) > 25 for w in words) / n, 0.0,
    ]


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        """To nine places, so that a text's score does not depend on the texts beside it in a batch."""
        return np.round(np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2, 9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_network(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int = 7, hidden: int = 24, epochs: int = 60, batch: int = 1024, rate: float = 0.01) -> Network:
    """Adam on the non-negative risk with sigmoid loss; prior None: plain logistic fit of positives against unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(0), np.maximum(both.std(0), 1e-6)
    p, u = (pos - mean) / scale, (unl - mean) / scale
    w = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    steps = max(1, -(-max(len(p), len(u)) // batch))

    def grads(x: np.ndarray, dz: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
        dh = dz[:, None] * w[2] * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dz, dz.sum(keepdims=True)]

    for _ in range(epochs):
        pi, ui = rng.permutation(len(p)), rng.permutation(len(u))
        for s in range(steps):
            xp, xu = p[np.resize(pi, (s + 1) * batch)[s * batch :][: len(p)]], u[np.resize(ui, (s + 1) * batch)[s * batch :][: len(u)]]
            hp, hu = np.tanh(xp @ w[0] + w[1]), np.tanh(xu @ w[0] + w[1])
            sp, su = _sigmoid(hp @ w[2] + w[3]), _sigmoid(hu @ w[2] + w[3])
            if prior is None:
                g = [a + b for a, b in zip(grads(xp, (sp - 1) / len(xp), hp), grads(xu, su / len(xu), hu))]
            else:  # losses: positive 1 - s, negative s
                dp, du = sp * (1 - sp) / len(xp), su * (1 - su) / len(xu)
                negative = su.mean() - prior * sp.mean()
                rest = [b - prior * a for a, b in zip(grads(xp, dp, hp), grads(xu, du, hu))]
                g = [a + b for a, b in zip(grads(xp, -prior * dp, hp), rest)] if negative >= 0 else [-b for b in rest]
            t += 1
            for k in range(4):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, w[0], w[1], w[2], float(w[3][0]))


def class_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 7) -> float:
    """Share of positives among the unlabelled: the smallest ratio of their shares above a score that few miss.

    The set above any score holds at most all positives of the mixture, so prior <= share_unl / share_pos; the bound is
    tight where nothing but positives is left. Ratios count only where at least a fifth of the positives lie above.
    """
    net = fit_network(pos, unl, None, seed, epochs=20)
    sp, su = np.sort(net.logits(pos)), np.sort(net.logits(unl))
    cuts = np.quantile(sp, np.linspace(0, 0.8, 81))
    above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    above_u = 1 - np.searchsorted(su, cuts) / len(su)
    slack = 1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su))
    return float(np.clip(np.min((above_u + slack / 4) / above_p), 0.05, 0.99))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.num_columns - 1
        rows = [features(t.as_py()) for t in batch.column(k)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names[:k], "x"])


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, folds: int = 5, seed: int = 7) -> Network | None:
    """Fit on at most `most` trusted positives and at most `most` unlabelled documents (the bound of the sample).

    Trusted: quality = 1 in labels, fold not 0; a doc_id with contradicting labels is not trusted. Unlabelled: documents
    without a label in another fold than 0. Both samples are those with the smallest hashes of doc_id, so reruns agree. With
    no positives or no unlabelled texts there is nothing to fit: None.
    """
    trusted = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("lo"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where((crc_fold(F.col("doc_id"), folds) != 0)).distinct()
    joined = ids.join(trusted.select(F.col("doc_id").cast("long").alias("doc_id"), "lo"), "doc_id", "left")
    pick = lambda cond: joined.where(cond).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most).select("doc_id", cond.alias("positive"))
    chosen = pick(F.coalesce(F.col("lo") == 1, F.lit(False))).withColumn("positive", F.lit(True)).unionAll(pick(F.col("lo").isNull()).withColumn("positive", F.lit(False)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "positive", "text")  # at most 2 * most ids
    got = rows.mapInArrow(_features, "doc_id bigint, positive boolean, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    pos, unl = (np.array(got.x[got.positive == flag].tolist(), float).reshape(-1, len(FEATURES)) for flag in (True, False))
    if not len(pos) or not len(unl):
        return None
    return fit_network(pos, unl, class_prior(pos, unl, seed), seed)


def _scorer(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 1
            x = np.array([features(t.as_py()) for t in batch.column(k)], float).reshape(-1, len(FEATURES))
            s = net.scores(x) if net else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(s)], names=[*batch.schema.names[:k], "score"])

    return run


def score(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep + score (0 to 1), one row per row of docs, no shuffle; without a network every score is 0.5.

    Scores depend on the text alone; null and empty texts are scored by the network as texts without words.
    """
    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep] + ["score double"])
    return docs.select(*[F.col(k) for k in keep], F.col("text").cast("string").alias("__text")).mapInArrow(_scorer(net), schema)


def _keeper(net: Network | None, threshold: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if net is None:
                yield batch
                continue
            x = np.array([features(t.as_py()) for t in batch.column(text_at)], float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(net.scores(x) >= threshold))

    return run


def keep_good(docs: DataFrame, net: Network | None, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores at least `threshold`, all columns kept, no shuffle; without a network all rows."""
    return docs.mapInArrow(_keeper(net, threshold, docs.columns.index("text")), docs.schema)
