"""Linear probe: a linear classifier on frozen embeddings, trained by mini-batches.

Each step of Adam sums the gradient of one batch where the rows are; tasks give
one row each, which are summed in two steps, and the weights, one row a class,
are all that comes to the driver. Batches are told by a hash of key and epoch, so
every run sees the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.operators import metrics, sampling
from concord.operators.cells import doubles, matrix_of
from concord.operators.small import attach

#: Epochs, batches an epoch and step size of a training.
EPOCHS, BATCHES, RATE = 3, 8, 0.1

GRADIENT = T.StructType([T.StructField(c, t) for c, t in (("sums", T.BinaryType()), ("hits", T.LongType()), ("n", T.LongType()))])


def _with_ones(v: pa.Array) -> np.ndarray:
    x = matrix_of(v)
    return np.hstack([x, np.ones((len(x), 1))])


def _gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum of the gradients of the cross entropy, and how many rows these weights get right."""
    z = x @ weights.T
    right = int((z.argmax(axis=1) == y).sum())
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(len(y)), y] -= 1
    return z.T @ x, right


def _summed(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Gradient, hits and rows of a batch (``y, v``)."""

    def total(sums: np.ndarray, hits: int, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"sums": [sums.tobytes()], "hits": [hits], "n": [n]})

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, hits, n = np.zeros_like(weights), 0, 0
        for batch in batches:
            if batch.num_rows:
                more, right = _gradient(_with_ones(batch["v"]), batch["y"].to_numpy(), weights)
                sums, hits, n = sums + more, hits + right, n + batch.num_rows
        if n:
            yield total(sums, hits, n)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if rows:
            sums = sum(np.frombuffer(r["sums"]).reshape(weights.shape) for r in rows)
            yield total(sums, sum(r["hits"] for r in rows), sum(r["n"] for r in rows))

    given = rows.select("y", "v").mapInArrow(parts, GRADIENT)
    tasks = rows.rdd.getNumPartitions()
    if tasks > 16:
        given = given.repartition(int(tasks**0.5)).mapInArrow(merge, GRADIENT)
    found = given.collect()
    sums = sum((np.frombuffer(r.sums).reshape(weights.shape) for r in found), np.zeros_like(weights))
    return sums, sum(r.hits for r in found), sum(r.n for r in found)


@dataclass
class Probe:
    """Weights by class position, the classes as a table, and accuracy in percent by epoch, from 1."""

    weights: np.ndarray
    classes: DataFrame
    history: list[float] = field(default_factory=list)

    def predict(self, rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
        """``key, truth, prediction`` for rows with a vector."""
        weights = self.weights
        fields = [T.StructField("key", rows.schema[key].dataType), T.StructField("truth", rows.schema[label].dataType)]

        def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best = (_with_ones(batch["v"]) @ weights.T).argmax(axis=1) if batch.num_rows else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch["key"], batch["truth"], pa.array(best)], ["key", "truth", "y"])

        given = rows.select(F.col(key).alias("key"), F.col(label).alias("truth"), doubles(vector).alias("v"))
        found = given.mapInArrow(classify, T.StructType([*fields, T.StructField("y", T.LongType())]))
        named = attach(found, self.classes.withColumnRenamed("class", "prediction"), ["y"])
        return named.select(F.col("key").alias(key), "truth", "prediction")

    def epochs(self) -> DataFrame:
        """``epoch, accuracy``: of the rows as they were met, before the step that learnt from them."""
        rows = [(e, a) for e, a in enumerate(self.history, 1)]
        return self.classes.sparkSession.createDataFrame(rows, "epoch bigint, accuracy double")


def train(
    rows: DataFrame,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    epochs: int = EPOCHS,
    batches: int = BATCHES,
    rate: float = RATE,
    seed: int = 42,
) -> Probe:
    """Adam on the cross entropy, from zero weights; classes of any type, numbered in sorted order by a join."""
    known = rows.dropna(subset=[label, vector])
    # One row per class.
    order = F.row_number().over(Window.orderBy("class")) - 1
    classes = known.select(F.col(label).alias("class")).distinct().withColumn("y", order.cast("bigint"))
    given = known.select(F.col(key).alias("key"), F.col(label).alias("class"), doubles(vector).alias("v"))
    numbered = attach(given, classes, ["class"]).select("key", "y", "v").persist()
    try:
        shape = numbered.agg(F.max("y"), F.max(F.size("v"))).first()
        if shape[0] is None:
            return Probe(np.zeros((0, 1)), classes)
        weights = np.zeros((shape[0] + 1, shape[1] + 1))
        first, second, history = np.zeros_like(weights), np.zeros_like(weights), []
        step = 0
        for epoch in range(epochs):
            hits = n = 0
            for batch in range(batches):
                of = F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "key"), F.lit(batches))
                sums, right, size = _summed(numbered.filter(of == batch), weights)
                if not size:
                    continue
                step, hits, n = step + 1, hits + right, n + size
                gradient = sums / size
                first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
                weights = weights - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            history.append(100.0 * hits / n)
        return Probe(weights, classes, history)
    finally:
        numbered.unpersist()


def linear_probe(
    vectors: DataFrame,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    train_share: float = 0.8,
    seed: int = 42,
    epochs: int = EPOCHS,
    batches: int = BATCHES,
    rate: float = RATE,
) -> DataFrame:
    """``key, truth, prediction`` on the test part of an exact split, after training on the rest."""
    parts = sampling.split(vectors.dropna(subset=[label, vector]).select(key, label, vector), key, train_share, seed)
    probe = train(parts.filter("subset = 'train'"), key, label, vector, epochs, batches, rate, seed)
    return probe.predict(parts.filter("subset = 'test'"), key, label, vector)


def probe_scores(tested: DataFrame) -> DataFrame:
    """Test rows, accuracy and macro scores of a probe in one row."""
    return metrics.report_from_cells(metrics.confusion(tested)).agg(
        F.sum("support").alias("test_samples"),
        (F.lit(100.0) * F.sum("tp") / F.sum("support")).alias("accuracy"),
        *[(F.avg(c) * 100.0).alias(f"macro_{c}") for c in metrics.MACRO],
    )
