"""Where queries meet vectors: dense distances within bounded groups of rows.

Vectors and queries are rows with a ``cell``. A cell's vectors come to one task
once, its queries stream past them, and each query leaves with its best
rows: no pair of vectors is ever a row, and nothing is copied but the
queries, once for each cell they visit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Squared distances are ranked at this many decimals, so that equal vectors tie and the key decides.
RANK_DECIMALS = 9

#: Queries that meet a cell at once, and vectors a cell is meant to hold.
QUERY_TILE, CELL = 256, 8192

VECTOR = T.ArrayType(T.DoubleType())


def doubles(vector: str) -> Column:
    return F.col(vector).cast(VECTOR)


def matrix_of(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    sizes = pc.min_max(pc.list_value_length(column))
    if sizes["min"] != sizes["max"]:
        raise ValueError(f"vectors of different lengths: {sizes['min']} to {sizes['max']}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def positions(keys: pa.Array) -> np.ndarray:
    """The place of each key in sorted order."""
    order = pc.sort_indices(keys).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place


def slack(*norms: np.ndarray) -> float:
    """What squared distances may differ by and still rank alike, besides errors of dense products."""
    return 2 * 10.0**-RANK_DECIMALS + 1e-12 * sum(float(n.max(initial=0)) for n in norms)


def squared(points: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Squared distances by a dense product; exact only up to ``slack``."""
    norms = (points * points).sum(axis=1)[:, None] + (matrix * matrix).sum(axis=1)
    return np.maximum(norms - 2 * points @ matrix.T, 0)


def nearest_rows(
    points: np.ndarray, matrix: np.ndarray, place: np.ndarray, k: int, reach: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, row, squared distance) of each point's ``k`` nearest rows, equal distances by ``place``.

    Dense products choose, and the distances of those chosen are computed from
    the differences. Rows further than ``reach`` (squared) are left out.
    """
    if not len(points) or not len(matrix):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    rough = squared(points, matrix)
    spare = slack((points * points).sum(axis=1), (matrix * matrix).sum(axis=1))
    cut = np.full(len(points), np.inf) if reach is None else reach + spare
    if len(matrix) > k:
        cut = np.minimum(cut, np.partition(rough, k - 1, axis=1)[:, k - 1] + spare)
    i, j = np.nonzero(rough <= cut[:, None])
    difference = matrix[j] - points[i]
    distance = (difference * difference).sum(axis=1)
    order = np.lexsort((place[j], distance.round(RANK_DECIMALS), i))
    i, j, distance = i[order], j[order], distance[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], distance[keep]


class _Cell:
    """The vectors of one cell, along their distance from its centre."""

    def __init__(self, number: int):
        self.number, self.parts, self.keys = number, [], None

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append(rows)

    def build(self) -> None:
        if self.parts:
            rows = pa.Table.from_batches(self.parts).combine_chunks()
            at = rows["at"].to_numpy()
            order = np.argsort(at, kind="stable")
            keys = rows["key"].combine_chunks()
            self.at, self.place, self.keys = at[order], positions(keys)[order], keys.take(pa.array(order))
            self.matrix, self.parts = matrix_of(rows["v"])[order], []

    def best(self, asked: pa.RecordBatch, k: int) -> pa.RecordBatch | None:
        """Rows (query, key, distance) of the nearest vectors within reach."""
        points, at, reach = matrix_of(asked["v"]), asked["at"].to_numpy(), asked["reach"].to_numpy()
        with np.errstate(over="ignore"):
            far = np.sqrt(reach + slack((points * points).sum(axis=1)))
        # no vector within reach has another distance from the centre than these
        low = int(np.searchsorted(self.at, (at - far).min(), side="left"))
        high = int(np.searchsorted(self.at, (at + far).max(), side="right"))
        i, j, distance = nearest_rows(points, self.matrix[low:high], self.place[low:high], k, reach)
        if not len(i):
            return None
        columns = [asked["query"].take(pa.array(i)), self.keys.take(pa.array(j + low)), pa.array(distance)]
        return pa.RecordBatch.from_arrays(columns, ["query", "key", "distance_sq"])


def meet(vectors: DataFrame, asked: DataFrame, k: int, tasks: int | None = None) -> DataFrame:
    """The ``k`` best rows of each cell for each query that visits it: ``query, key, distance_sq``.

    ``vectors`` has ``cell, at, key, v`` and ``asked`` ``cell, at, reach, query, v``:
    ``at`` is a distance from a point that all rows of a cell share (0 where there
    is none), ``reach`` the largest squared distance of interest, ``query`` any
    columns to be carried along.
    """
    key, query = vectors.schema["key"], asked.schema["query"]
    left = vectors.select("cell", F.lit(0).alias("kind"), "at", F.lit(0.0).alias("reach"), "key", F.lit(None).cast(query.dataType).alias("query"), "v")
    right = asked.select("cell", F.lit(1).alias("kind"), "at", "reach", F.lit(None).cast(key.dataType).alias("key"), "query", "v")
    found = T.StructType([query, key, T.StructField("distance_sq", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None
        for batch in batches:
            numbers, kinds = batch["cell"].to_numpy(), batch["kind"].to_numpy()
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)], strict=True):
                if cell is None or cell.number != numbers[low]:
                    cell = _Cell(numbers[low])
                if kinds[low] == 0:
                    cell.add(batch.slice(low, high - low))
                    continue
                cell.build()
                if cell.keys is not None:
                    for at in range(low, high, QUERY_TILE):
                        rows = cell.best(batch.slice(at, min(QUERY_TILE, high - at)), k)
                        if rows is not None:
                            yield rows

    both = left.union(right)
    dealt = both.repartition(tasks, "cell") if tasks else both.repartition("cell")
    return dealt.sortWithinPartitions("cell", "kind").mapInArrow(run, found)


def ranked(found: DataFrame, names: Sequence[str], k: int, tie: str = "key") -> DataFrame:
    """Rank, from 1, within ``names`` by distance and then key, in two steps; the first ``k``."""
    near = [F.round("distance_sq", RANK_DECIMALS), F.col(tie)]
    some = Window.partitionBy(*names, F.pmod(F.xxhash64(tie), F.lit(32))).orderBy(*near)
    first = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(*near)).cast("bigint")
    return first.withColumn("rank", rank).filter(F.col("rank") <= k)


def salted(key: str, n: Column) -> Column:
    """A number below ``n`` for each key, to spread the rows of a large group over several cells."""
    return F.pmod(F.xxhash64(F.lit(7), key), n)
