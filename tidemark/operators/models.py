"""Model surface on pyspark.ml, with market probabilities as the baseline, and a nearest-neighbour memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def logistic(features: list[str], label: str, weight: str | None = None, reg: float = 0.01) -> Pipeline:
    """Median imputation, missing flags, scaling and L2 logistic regression; fit it on train rows only."""
    filled = [f"{c}__f" for c in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True)]
    lr = LogisticRegression(featuresCol="__x", labelCol=label, regParam=reg, maxIter=50)
    return Pipeline(stages=[*stages, lr.setWeightCol(weight) if weight else lr])


def residual_trees(features: list[str], residual: str, seed: int = 42) -> Pipeline:
    """Boosted trees on what the market probability leaves over."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep"), GBTRegressor(featuresCol="__x", labelCol=residual, maxDepth=3, maxIter=20, stepSize=0.1, seed=seed)])


def ridge(features: list[str], label: str, reg: float = 1.0, elastic: float = 0.0) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), LinearRegression(featuresCol="__x", labelCol=label, regParam=reg, elasticNetParam=elastic)])


def scored(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "__x", "__raw")


def affine_calibration(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope and intercept of y on x, one row."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


class _Asked:
    """Unit vectors of a block of queries and their k best memory rows so far, best first; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, k: int):
        self.ids, self.unit, self.single = ids, unit, unit.astype(np.float32)
        self.sim, self.value = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.nan)
        self.mid = np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, mids: np.ndarray, unit: np.ndarray, values: np.ndarray) -> None:
        """Single precision tells which rows may be among the k best, double precision which are.

        A product of unit vectors of d components is off by less than (d + 4) / 2^24 in single precision; twice that, for
        the bound and the row, twice over, and the ninth place: a row below the bound by more is none of the k best."""
        k, flat = self.sim.shape[1], np.ascontiguousarray(unit.T, np.float32)
        slack = 4 * (unit.shape[1] + 4) / 2**24 + 1e-8
        for at in range(0, len(self.ids), 512):  # so that no more than 512 rows of similarities are held
            mine, bound = self.ids[at : at + 512], self.sim[at : at + 512, -1]
            s = self.single[at : at + 512] @ flat
            if len(mids) >= k and np.isinf(bound).any():  # the first rows set the bound themselves
                others = np.where(mine[:, None] == mids, -np.inf, s)
                bound = np.maximum(bound, np.partition(others, -k, axis=1)[:, -k])
            row, col = np.divmod(np.flatnonzero(s >= (bound - slack).astype(np.float32)[:, None]), len(mids))
            if len(row) > s.size // 64:  # many copies
                sim = (self.unit[at : at + 512] @ unit.T)[row, col]
            else:
                sim = np.einsum("ij,ij->i", self.unit[at + row], unit[col])
            sim, mid, last = np.round(sim, 9), mids[col], self.sim[at + row, -1]  # as alike as nine places tell
            better = (mine[row] != mid) & ((sim > last) | (sim == last) & (mid < self.mid[at + row, -1]))
            if better.any():
                self._keep(at + row[better], sim[better], mid[better], values[col[better]])

    def _keep(self, row: np.ndarray, sim: np.ndarray, mid: np.ndarray, value: np.ndarray) -> None:
        k, rows = self.sim.shape[1], np.unique(row)
        row, sim, mid, value = (np.concatenate([x.ravel(), y]) for x, y in ((np.repeat(rows, k), row), (self.sim[rows], sim), (self.mid[rows], mid), (self.value[rows], value)))
        order = np.lexsort((mid, -sim, row))
        best = order[np.searchsorted(row[order], rows)[:, None] + np.arange(k)]
        self.sim[rows], self.mid[rows], self.value[rows] = sim[best], mid[best], value[best]

    def best(self) -> pa.RecordBatch:
        got = np.isfinite(self.sim)
        ids = np.repeat(self.ids, got.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(self.sim[got]), pa.array(self.value[got], from_pandas=True), pa.array(self.mid[got])], names=["id", "sim", "value", "mid"])


def _unit_rows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, unit vectors and values; rows with a component that is no finite number take no part."""
    v = part.column("v")
    if len(v.value_lengths().unique()) > 1:
        raise ValueError("vectors of different lengths")
    x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)
    size = np.linalg.norm(x, axis=1)
    good = np.isfinite(size)
    ids, values = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "value"))
    return ids[good], x[good] / np.maximum(size[good], 1e-300)[:, None], values[good].astype(float)


def memory_values(queries: DataFrame, memory: DataFrame, k: int = 5, beta: float | None = None, block: int = 16384) -> DataFrame:
    """id and the mean (or softmax(beta * cosine) weighted mean) value of the k most similar memory rows.

    queries: id, v (array<float> or array<double>); memory: id, v, value; a query's own id is no memory. A task holds one
    block of queries with k rows each, past which a share of the memory streams; where there are few blocks, the memory is
    dealt into several shares, and their best are merged. The search is exact, so its work is queries times memory, and
    each memory row is sent to every block of queries. Null values count in no mean. NULL with an empty memory.
    """
    asks, shares = max(1, -(-queries.count() // block)), max(1, -(-4 * memory.count() // block))
    shares = min(shares, -(-int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) // asks))
    own = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    q = queries.select(own(asks).alias("a"), every(shares).alias("b"), F.lit(0).alias("side"), F.col("id").cast("long").alias("id"), "v", F.lit(None).cast("double").alias("value"))
    m = memory.select(every(asks).alias("a"), own(shares).alias("b"), F.lit(1).alias("side"), F.col("id").cast("long").alias("id"), "v", F.col("value").cast("double").alias("value"))
    met = q.unionAll(m).where("id IS NOT NULL AND v IS NOT NULL").withColumn("cell", F.col("a") * shares + F.col("b")).select("cell", "side", "id", "v", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = [], None
        for batch in batches:  # the queries first
            n = int((batch.column("side").to_numpy() == 0).sum())
            if n:
                held.append(_unit_rows(batch.slice(0, n)))
            if n == batch.num_rows or not held:
                continue
            if asked is None:
                asked = _Asked(*(np.concatenate(x) for x in list(zip(*held))[:2]), k)
            mids, unit, values = _unit_rows(batch.slice(n))
            for at in range(0, len(mids), 2048):
                asked.see(mids[at : at + 2048], unit[at : at + 2048], values[at : at + 2048])
        if asked is not None:
            yield asked.best()

    near = met.repartitionById(asks * shares, F.col("cell")).sortWithinPartitions("side").mapInArrow(run, "id long, sim double, value double, mid long")
    best = near.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", (-F.col("mid")).alias("o"), "value")), False), 1, k).alias("top"))
    weight = (lambda s: F.exp(F.lit(beta) * (s["sim"] - F.col("top")[0]["sim"]))) if beta is not None else (lambda s: F.lit(1.0))
    known = F.filter("top", lambda s: s["value"].isNotNull())
    total = F.aggregate(F.transform(known, weight), F.lit(0.0), lambda a, x: a + x)
    value = F.try_divide(F.aggregate(F.transform(known, lambda s: weight(s) * s["value"]), F.lit(0.0), lambda a, x: a + x), total)
    return queries.select("id").join(best.select("id", value.alias("memory_value")), "id", "left")
