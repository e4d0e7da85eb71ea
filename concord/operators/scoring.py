"""User-supplied scorers over partitions.

A factory is called once per partition, as loading a model is the dear part.
What it returns works on a batch of at most ``batch_size`` records, whatever
Spark sends at once: records may be files that take much room once decoded. A
batch that fails is halved until the bad records stand alone, so one of them
costs a few extra calls and never its neighbours.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions import fixed_values as fixed
from concord.operators import metrics

Scorer = Callable[[pd.DataFrame], Sequence]
#: Records given to a scorer at once. Files need far less: 4 in the programs rebuilt here.
BATCH_SIZE = 1024


def _parts(batch, size: int) -> Iterator:
    for at in range(0, len(batch), size):
        yield batch.iloc[at : at + size]


def _halving(work: Callable[[object], Sequence], batch, failed) -> tuple[list, list]:
    """One result per record and the seconds it took; ``failed`` and 0.0 where ``work`` raises.

    Records that were worked on together share the time equally. As many
    results as records are expected; else none of them can be told apart.
    """
    start, whole = time.perf_counter(), len(batch) <= 1
    try:
        results = list(work(batch))
        if len(results) == len(batch):
            return results, [(time.perf_counter() - start) / max(len(batch), 1)] * len(batch)
        whole = True
    except Exception:
        pass
    if whole:
        return [failed] * len(batch), [0.0] * len(batch)
    middle = len(batch) // 2
    first, second = (_halving(work, part, failed) for part in (batch.iloc[:middle], batch.iloc[middle:]))
    return first[0] + second[0], first[1] + second[1]


def score_partitions(
    df: DataFrame,
    factory: Callable[[], Scorer],
    inputs: Sequence[str],
    key: str = "item_id",
    latency: bool = False,
    num_partitions: int | None = None,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """One prediction per record: ``key, prediction[, latency_s]``, as many rows as came in.

    A record that fails gives ``Error_Processing``; when the factory fails
    every record gives ``Error_Model_Load``. ``num_partitions`` spreads a
    costly scorer over more tasks than the scan has; records that differ much
    in size are given as ``files.placed_by_size`` deals them. A latency is a record's
    share of its batch; ``batch_size=1`` times each record on its own.
    """
    load_error, record_error = fixed.ERROR_MODEL_LOAD, fixed.ERROR_PROCESSING
    fields = [df.schema[key], T.StructField("prediction", T.StringType())]
    if latency:
        fields.append(T.StructField("latency_s", T.FloatType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            score = factory()
        except Exception:
            score = None
        for batch in batches:
            for part in _parts(batch, batch_size):
                if score is None:
                    labels, seconds = [load_error] * len(part), [0.0] * len(part)
                else:
                    labels, seconds = _halving(score, part, record_error)
                out = {key: part[key], "prediction": labels}
                if latency:
                    out["latency_s"] = np.asarray(seconds, dtype="float32")
                yield pd.DataFrame(out)

    rows = df.select(key, *[c for c in inputs if c != key])
    if num_partitions:
        rows = rows.repartition(num_partitions)
    return rows.mapInPandas(run, T.StructType(fields))


Embedder = Callable[[pd.Series], Sequence]


def each_record(factory: Callable[[], Callable[[object], Sequence[float]]]) -> Callable[[], Embedder]:
    """A batch embedder from a factory of functions for one record."""

    def make() -> Embedder:
        vector = factory()
        return lambda records: [vector(record) for record in records]

    return make


def embed_column(factory: Callable[[], Embedder], batch_size: int = BATCH_SIZE) -> Callable[[Column], Column]:
    """A column function from records to vectors, null for a record that fails.

    The factory returns a function from a series of records to their vectors,
    so decoding and one model call can share a batch.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors = factory()
        for batch in batches:
            out = []
            for part in _parts(batch, batch_size):
                out += _halving(vectors, part, None)[0]
            yield pd.Series(out, dtype=object)

    # Otherwise a filter derived from a later explode would run the costly function a second time.
    return embed.asNondeterministic()


def embed_partitions(
    df: DataFrame,
    factory: Callable[[], Embedder],
    key: str = "path",
    content: str = "content",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """``key, embedding`` with L2-normalised vectors; a record that fails gives no row."""
    schema = T.StructType([df.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = factory()
        for batch in batches:
            for part in _parts(batch, batch_size):
                found, _ = _halving(vectors, part[content], None)
                keep = np.array([v is not None and bool(np.any(v)) for v in found], dtype=bool)
                if keep.any():
                    raw = [np.asarray(v, dtype="float64") for v, k in zip(found, keep) if k]
                    units = [(v / np.sqrt((v * v).sum())).astype("float32") for v in raw]
                    yield pd.DataFrame({key: part[key][keep], "embedding": pd.Series(units, index=part.index[keep])})

    return df.select(key, content).mapInPandas(run, schema)


def evaluate_grid(
    records: DataFrame,
    factory: Callable[[str], Scorer],
    inputs: Sequence[str],
    truth: str = "truth",
    keys: tuple[str, str] = ("dataset", "model"),
    batch_size: int = BATCH_SIZE,
    spread: int = 32,
) -> DataFrame:
    """Test size, accuracy and macro scores per (dataset, model), or the error that stopped that task.

    ``factory`` makes the scorer of a model. Rows are put in order of the model
    inside ``spread`` lanes each, so a task holds one scorer at a time and loads
    each once, and a large model spreads over many tasks. A factory that fails
    is not called again in that task. Each batch gives counted (truth,
    prediction) cells, so only counters are shuffled on. One failed batch fails
    the whole (dataset, model). Labels are compared as text; a null truth is no
    class, and its record is left out.
    """
    dataset, model = keys
    schema = f"{dataset} string, {model} string, truth string, prediction string, error string, n bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str | None, Scorer | None, str | None] = (None, None, None)
        for batch in batches:
            cells: dict[tuple, int] = {}
            for (name, data), rows in batch.groupby([model, dataset], sort=False, dropna=False):
                if held[0] != name or (held[1] is None and held[2] is None):
                    held = (None, None, None)  # the last scorer goes before the next one comes
                    try:
                        held = (name, factory(name), None)
                    except Exception as e:
                        held = (name, None, f"{type(e).__name__}: {e}")
                error, data = held[2], None if pd.isna(data) else data
                predicted: list[str] = []
                try:
                    for part in _parts(rows, batch_size) if error is None else ():
                        found = [str(p) for p in held[1](part)]
                        if len(found) != len(part):
                            raise ValueError("as many predictions as records expected")
                        predicted += found
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                if error is not None:
                    cell = (data, name, None, None, error)
                    cells[cell] = cells.get(cell, 0) + len(rows)
                    continue
                for true, label in zip(rows[truth], predicted):
                    cell = (data, name, str(true), label, None)
                    cells[cell] = cells.get(cell, 0) + 1
            out = pd.DataFrame([(*cell, n) for cell, n in cells.items()], columns=columns_out)
            yield out.astype({c: object for c in columns_out[:-1]})

    columns_out = [dataset, model, "truth", "prediction", "error", "n"]
    columns = list(dict.fromkeys([dataset, model, truth, *inputs]))
    lane = F.pmod(F.xxhash64(*columns), F.lit(spread)).alias("_lane")
    laned = records.filter(F.col(truth).isNotNull()).select(*columns, lane).repartition(model, "_lane")
    counted = laned.sortWithinPartitions(model).drop("_lane").mapInPandas(run, schema)
    # A failed part is a cell without labels; its error is a key, so counting stays a hash aggregation.
    cells = counted.groupBy(dataset, model, "truth", "prediction", "error").agg(F.sum("n").alias("n"))
    labels = metrics.report_from_cells(cells, [dataset, model, "error"])
    known = F.col("label").isNotNull()
    figures = {
        "num_classes": F.count_if(known & (F.col("support") > 0)),
        "test_samples": F.sum("support"),
        "accuracy": F.lit(100.0) * F.sum("tp") / F.sum("support"),
        **{f"macro_{c}": F.avg(F.when(known, F.col(c))) * 100.0 for c in metrics.MACRO},
    }
    # One row per label from here on; the figures of a failed task are dropped.
    totals = labels.groupBy(dataset, model).agg(
        *[c.alias(name) for name, c in figures.items()], F.min("error").alias("error")
    )
    ok = F.col("error").isNull()
    return totals.select(dataset, model, *[F.when(ok, F.col(name)).alias(name) for name in figures], "error")
