"""Exact top-k search with multi-resolution segment statistics.

Vectors are cut into segments, at each of a few resolutions, and described by
the mean and deviation of each segment. They bound the distance of two vectors
from below (reverse triangle inequality on the deviations), so with both norms
they bound the inner product from above: ``2 q.x = |q|^2 + |x|^2 - d^2``.
Candidates fall out from the coarsest resolution to the finest once their
bound is below the k-th exact score so far; survivors are scored exactly in
integers.

Queries and candidates meet in blocks: a grid of query blocks and candidate
lanes spreads the pairs over tasks, each task keeps k rows a query, and a last
ranking takes the best of the lanes. Neither side is broadcast or collected.

Defined results: vectors that are null or hold null or non-finite components
take no part; empty vectors and the end of shorter ones count as zeros;
components and scores beyond the range of a long stop at its ends. A row is
never its own candidate, but rows that repeat its id are. A null id is no
query; as a candidate it comes after all ids in ties. An empty table gives no
rows; only the two named columns are read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import n_tasks, schema, written

SCALE = 256
EVERY = 50
QUERY_BLOCK, CANDIDATE_BLOCK = 256, 1024
RESOLUTIONS = (1, 4, 16)
#: One in so many pairs left is reason to multiply whole blocks instead of picked rows.
DENSE = 64
SLACK = 1e-9
MOST, LEAST = 2**63 - 1, -(2**63)

BLOCKS = schema(block="long", n="int", size="int", rows="binary", ids="binary", no_ids="binary", data="binary")
FOUND = schema(query_row="long", query_id="long", row="long", vec_id="long", score="long")


def quantised(vectors: DataFrame) -> DataFrame:
    """row, vec_id and integer components of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.filter(F.col("embedding").isNotNull() & ~bad)
    parts = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return kept.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), parts.alias("v")
    )


def blocks(vectors: DataFrame, most: int) -> DataFrame:
    """Rows packed into blocks of at most ``most`` vectors."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), most):
                part = batch.iloc[at : at + most]
                size = max(map(len, part.v))
                data = np.zeros((len(part), size), dtype="<i8")
                for i, v in enumerate(part.v):
                    data[i, : len(v)] = v
                columns = (part.row, part.vec_id, part.no_id)
                kinds = ("<i8", "<i8", "u1")
                arrays = [c.to_numpy().astype(kind).tobytes() for c, kind in zip(columns, kinds, strict=True)]
                yield pd.DataFrame([(number, len(part), size, *arrays, data.tobytes())], columns=BLOCKS.names)
                number += 1

    named = vectors.select(
        "row", F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"), "v"
    )
    return named.mapInPandas(packed, BLOCKS)


class Block:
    """A block unpacked, with its segment statistics."""

    def __init__(self, n: int, size: int, rows: bytes, ids: bytes, no_ids: bytes, data: bytes):
        self.rows, self.ids = np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8")
        self.no_ids = np.frombuffer(no_ids, "u1")
        self.data = np.frombuffer(data, "<i8").reshape(n, size)
        self.most = max(abs(int(self.data.max(initial=0))), abs(int(self.data.min(initial=0))))

    def widened(self, size: int) -> np.ndarray:
        return np.pad(self.data, ((0, 0), (0, size - self.data.shape[1])))


def statistics(data: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment, times the root of its length."""
    x, size = data.astype(float), data.shape[1]
    edges = np.unique(np.linspace(0, size, min(segments, size) + 1).astype(int))
    if size == 0:
        return np.zeros((len(x), 0)), np.zeros((len(x), 0))
    lengths = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / lengths
    square = np.add.reduceat((x - np.repeat(mean, lengths, axis=1)) ** 2, edges[:-1], axis=1)
    return mean * np.sqrt(lengths), np.sqrt(square)


def described(data: np.ndarray) -> list[np.ndarray]:
    """Means and deviations side by side for each resolution, coarsest first.

    Their squares add up to the vector's own, so the bound ``(|q|^2 + |x|^2 - d^2) / 2``
    of two vectors, ``d`` the distance of their statistics, is the product of these rows.
    """
    return [np.hstack(statistics(data, segments)) for segments in RESOLUTIONS]


def exact(q: np.ndarray, x: np.ndarray, small: bool) -> np.ndarray:
    """Inner products of row pairs, in integers."""
    if small:
        return np.einsum("ij,ij->i", q, x)
    products = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(q, x, strict=True)]
    return np.array([min(max(p, LEAST), MOST) for p in products], dtype=np.int64)


class Best:
    """The k best candidates so far of each query of a block."""

    def __init__(self, queries: Block, k: int):
        n = len(queries.rows)
        self.queries, self.k = queries, k
        self.found = [[] for _ in range(n)]  # (-score, no id, id, row)
        self.least = np.full(n, -np.inf)
        self.described: dict[int, list[np.ndarray]] = {}

    def take(self, at: np.ndarray, x: Block, columns: np.ndarray, scores: np.ndarray, plain: bool) -> None:
        order = np.lexsort((x.rows[columns], x.ids[columns], x.no_ids[columns], -scores.astype(float), at))
        at, columns, scores = at[order], columns[order], scores[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
        for low, high in zip(starts, np.r_[starts[1:], len(at)][: len(starts)], strict=True):
            found = self.found[i := int(at[low])]
            # large scores close to each other may tie as doubles: cut by the integer of the k-th
            cut = min(high, low + self.k)
            while not plain and cut < high and float(scores[cut]) == float(scores[cut - 1]):
                cut += 1
            for c, s in zip(columns[low:cut].tolist(), scores[low:cut].tolist(), strict=True):
                found.append((-s, int(x.no_ids[c]), int(x.ids[c]), int(x.rows[c])))
            found.sort()
            del found[self.k :]
            if len(found) == self.k:
                self.least[i] = -found[-1][0]

    def levels(self, size: int) -> list[np.ndarray]:
        """The queries' statistics, coarsest first, kept for the next block of the same size."""
        if size not in self.described:
            self.described = {size: described(self.queries.widened(size))}
        return self.described[size]

    def search(self, x: Block) -> None:
        size = max(self.queries.data.shape[1], x.data.shape[1])
        q, v = self.queries.widened(size), x.widened(size)
        largest = self.queries.most * x.most * max(size, 1)
        small, plain = largest < 2**62, largest < 2**53
        norms = (q.astype(float) ** 2).sum(1), (v.astype(float) ** 2).sum(1)
        slack = SLACK * (norms[0].max(initial=0) + norms[1].max(initial=0)) + 0.5
        other = self.queries.rows[:, None] != x.rows[None, :]
        levels = list(zip(self.levels(size), described(v), strict=True))
        finest = levels[-1][0] @ levels[-1][1].T
        near = np.where(other, finest, -np.inf)
        first = np.argpartition(-near, min(self.k, near.shape[1] - 1), axis=1)[:, : self.k]
        i, j = np.repeat(np.arange(len(q)), first.shape[1]), first.ravel()
        i, j = i[keep := other[i, j]], j[keep]
        seeds = exact(q[i], v[j], small)
        least = self.least.copy()
        full = np.bincount(i, minlength=len(q)) == self.k
        lowest = np.full(len(q), np.inf)
        np.minimum.at(lowest, i, seeds.astype(float))
        least[full] = np.maximum(least, lowest)[full]  # k exact scores of this block are a threshold for the rest of it
        alive = other
        for qs, xs in levels[:-1]:
            alive &= qs @ xs.T + slack >= least[:, None]
        alive &= finest + slack >= least[:, None]
        i, j = np.nonzero(alive)
        if plain and len(i) * DENSE > alive.size:  # doubles hold these sums exactly
            scores = (q.astype(float) @ v.astype(float).T)[i, j].astype(np.int64)
        else:
            parts = [slice(a, a + 65536) for a in range(0, len(i), 65536)]
            scores = np.concatenate([exact(q[i[p]], v[j[p]], small) for p in parts] or [np.zeros(0, np.int64)])
        keep = scores >= least[i]
        self.take(i[keep], x, j[keep], scores[keep], plain)


def search(vectors: DataFrame, k: int = 5, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    vectors = written(quantised(vectors))
    queries = blocks(vectors.filter(F.col("vec_id") % every == 0).coalesce(n_tasks(spark)), QUERY_BLOCK)
    queries = written(queries)
    numbers = queries.select("block").withColumn("q", F.row_number().over(Window.orderBy("block")) - 1)
    queries = queries.join(numbers, "block")  # a number per block is all that meets in one task
    n = numbers.count()
    lanes = -(-2 * n_tasks(spark) // max(n, 1))
    candidates = blocks(vectors, CANDIDATE_BLOCK).withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)))
    parts = BLOCKS.names[1:]
    asked = queries.select(
        "q", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), *[F.col(c).alias(f"q_{c}") for c in parts]
    )
    if n == 0:
        asked = asked.limit(0)
    given = candidates.select(
        F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("q"), F.col("lane").cast("int").alias("lane"), *parts
    )

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, Best] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.q not in best:
                    best[row.q] = Best(Block(*(getattr(row, f"q_{c}") for c in parts)), k)
                best[row.q].search(Block(*(getattr(row, c) for c in parts)))
        for b in best.values():
            rows = [
                (int(b.queries.rows[i]), int(b.queries.ids[i]), r, None if none else v, -s)
                for i, found in enumerate(b.found)
                for s, none, v, r in found
            ]
            yield pd.DataFrame(rows, columns=FOUND.names).astype({"vec_id": "Int64"})

    cells = asked.hint("shuffle_hash").join(given, ["q", "lane"]).select("q", *[f"q_{c}" for c in parts], *parts)
    found = cells.mapInPandas(meet, FOUND)
    rank = F.row_number().over(
        Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row"))
    )
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
