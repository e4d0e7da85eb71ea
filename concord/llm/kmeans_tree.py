"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` rows, fewer where they would
exceed ``SAMPLE_BYTES``, those of least hash): k-means splits each node into up
to ``BRANCH`` children until a leaf holds about ``LEAF_SAMPLE`` sampled rows.
Every row then descends to its leaf, so the index holds all of them.

A query goes through the tree with a priority queue: the node whose centre has
the largest inner product with the query is opened next, and leaves are visited
in the order in which they leave the queue. How many leaves are visited is
calibrated: for ``ASKED`` queries the true neighbours are found by brute force,
and visits are widened until they hold ``TARGET`` of them. A query that has met
fewer than k rows by then goes on.

Leaves are dealt over lanes of about ``LANE_ROWS`` rows, neighbouring leaves
together, and leaves larger than a lane over several. A query goes once to each
lane it visits, with the leaves to visit there; a task holds one lane and lets
the queries stream past it. Scores are inner products in double precision of
the vectors as given, summed alike for every pair, so equal vectors tie.

Copies of one vector are one class: the ``k + 1`` smallest ids of a class stand
for it, since no query needs more of them, and queries that are copies are
answered once. So a vector that fills a third of the table costs no more than others.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part; shorter vectors count as ending in zeros; a row is
never its own neighbour, but rows that repeat its id are; a null id is no query
and comes last in ties; with fewer than k other rows all are returned; an empty
table gives no rows; only the two named columns are read, so names cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import schema, written

EVERY, TOP = 20, 20
SAMPLE, SAMPLE_BYTES = 16_384, 32 << 20
BRANCH, LEAF_SAMPLE, ROUNDS = 16, 16, 8
ASKED, TARGET = 100, 0.95
LANE_ROWS, LANE_BYTES = 8192, 32 << 20
#: Queries that meet a lane at once.
QUERY_TILE = 256

FOUND = schema(a="long", b="long", row="long", vec_id="long", no_id="boolean", score="double")
TRUTH = schema(query="int", row="long", leaf="int", score="double")
VECTOR = T.ArrayType(T.DoubleType())
PROBE = T.StructType(
    [
        *schema(lane="int", kind="int", a="long", b="long", row="long", vec_id="long", no_id="boolean").fields,
        T.StructField("leaves", T.ArrayType(T.IntegerType())),
        T.StructField("v", VECTOR),
    ]
)


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def split(points: np.ndarray, k: int) -> np.ndarray:
    """The cluster of each point, by k-means from evenly spread starts."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        of = nearest_centre(points, centres)
        for j in range(k):
            if (own := of == j).any():
                centres[j] = points[own].mean(axis=0)
    return nearest_centre(points, centres)


class Tree:
    """Centres of all nodes, children of the inner ones, and a number for each leaf, side by side leaves in a row."""

    def __init__(self, points: np.ndarray):
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.n_leaves = 0
        centres: list[np.ndarray] = []

        def grow(own: np.ndarray) -> int:
            node = len(centres)
            centres.append(own.mean(axis=0))
            self.children.append([])
            self.leaf.append(-1)
            if len(own) > 2 * LEAF_SAMPLE:
                of = split(own, min(BRANCH, len(own) // LEAF_SAMPLE))
                parts = [own[of == j] for j in np.unique(of)]
                if len(parts) > 1:
                    self.children[node] = [grow(p) for p in parts]
                    return node
            self.leaf[node] = self.n_leaves
            self.n_leaves += 1
            return node

        grow(points)
        self.centres = np.array(centres)

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: down to the nearest child, node by node."""
        out = np.zeros(len(points), dtype=np.int32)
        waiting = [(0, np.arange(len(points)))]
        while waiting:
            node, own = waiting.pop()
            children = self.children[node]
            if not children:
                out[own] = self.leaf[node]
                continue
            of = nearest_centre(points[own], self.centres[children])
            waiting += [(c, part) for j, c in enumerate(children) if len(part := own[of == j])]
        return out

    def best_bins(self, scores: list[float]) -> Iterator[int]:
        """Leaves in best-bin-first order for the scores of one query with all centres."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf[node]
            for child in self.children[node]:
                heapq.heappush(queue, (-scores[child], child))


class Lanes:
    """Where the rows of each leaf are kept: the first of its lanes and how many they are."""

    def __init__(self, sizes: np.ndarray, dims: int):
        rows = max(1, min(LANE_ROWS, LANE_BYTES // (8 * dims)))
        self.first, self.n, self.sizes = [], [], sizes.tolist()
        lane = held = 0
        for size in self.sizes:
            many = -(-size // rows)
            if held and held + size > rows:
                lane, held = lane + 1, 0
            self.first.append(lane)
            self.n.append(max(1, many))
            if many > 1:
                lane, held = lane + many, 0
            else:
                held += size
        self.count = lane + 1


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """row, vec_id, vector in doubles and two hashes of it, of the vectors that take part, all of one length."""
    given = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), given.alias("v"))
    rows = written(rows.filter(F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    padded = F.when(F.size("v") == dims, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("v"))))
    rows = rows.withColumn("v", padded)
    return rows.withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(1), "v")})


class Index:
    """A tree and the table of all candidate rows with their leaves."""

    def __init__(self, vectors: DataFrame, k: int = TOP):
        self.k, self.rows = k, usable(vectors)
        self.dims = len((self.rows.select("v").first() or [[]])[0])
        some = Window.partitionBy("a", "b", F.pmod(F.xxhash64("row"), F.lit(32)))
        order = [F.asc_nulls_last("vec_id"), F.asc("row")]
        first = self.rows.withColumn("place", F.row_number().over(some.orderBy(*order))).filter(F.col("place") <= k + 1)
        place = F.row_number().over(Window.partitionBy("a", "b").orderBy(*order))
        first = first.withColumn("place", place).filter(F.col("place") <= k + 1)
        if not self.dims:
            self.table = first.withColumn("leaf", F.lit(0))
            return
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * self.dims)))
        self.table = written(first)
        sample = self.table.orderBy(F.xxhash64("row"), "row").limit(most).select("v")
        self.tree = tree = Tree(np.array([r.v for r in sample.toLocalIterator()], dtype=float))

        @F.pandas_udf(T.IntegerType())
        def leaf(v: pd.Series) -> pd.Series:
            return pd.Series(tree.assign(matrix(v)))

        self.table = written(self.table.withColumn("leaf", leaf("v")))
        sizes = np.zeros(tree.n_leaves, dtype=np.int64)
        for r in self.table.groupBy("leaf").count().collect():  # a row a leaf
            sizes[r["leaf"]] = r["count"]
        self.lanes = Lanes(sizes, self.dims)

    def truth(self, asked: list) -> dict[int, list[int]]:
        """The leaves of the true k nearest rows of a few queries, by brute force."""
        k, own = self.k, [r.row for r in asked]
        points = np.array([r.v for r in asked], dtype=float)

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = pd.DataFrame(columns=TRUTH.names)
            for batch in batches:
                scores, rows = points @ matrix(batch.v).T, batch.row.to_numpy()
                parts = []
                for i, s in enumerate(scores):
                    at = np.argpartition(-s, min(k, len(s) - 1))[: k + 1]
                    at = at[rows[at] != own[i]]
                    parts.append(pd.DataFrame({"query": i, "row": rows[at], "leaf": batch.leaf.to_numpy()[at], "score": s[at]}))
                held = pd.concat(([held] if len(held) else []) + parts)
                held = held.sort_values("score", ascending=False).groupby("query").head(k)
            if len(held):
                yield held

        found = self.table.select("row", "leaf", "v").mapInPandas(compare, TRUTH)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "row"))
        near: dict[int, list[int]] = {}
        for r in found.withColumn("rank", rank).filter(F.col("rank") <= k).collect():  # ASKED * k rows at most
            near.setdefault(r["query"], []).append(r["leaf"])
        return near

    def calibrate(self, asked: DataFrame, target: float = TARGET) -> tuple[int, float]:
        """The fewest leaf visits that hold ``target`` of the true neighbours of ``ASKED`` queries, and the share held."""
        some = asked.orderBy("a", "b").limit(ASKED).collect()
        if not some:
            return 1, 1.0
        near, needed = self.truth(some), []
        scores = np.array([r.v for r in some], dtype=float) @ self.tree.centres.T
        for i, leaves in near.items():
            filled = [x for x in self.tree.best_bins(scores[i].tolist()) if self.lanes.sizes[x]]
            place = {x: n for n, x in enumerate(filled, 1)}
            needed += [place[x] for x in leaves]
        if not needed:
            return 1, 1.0
        needed.sort()
        visits = 1
        while sum(n <= visits for n in needed) < target * len(needed):
            visits += 1
        return visits, sum(n <= visits for n in needed) / len(needed)

    def probes(self, asked: DataFrame, visits: int) -> DataFrame:
        """A row for each query and lane that it visits, with the leaves to visit there."""
        tree, lanes, k = self.tree, self.lanes, self.k

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                scores = matrix(batch.v) @ tree.centres.T
                for a, b, v, own in zip(batch.a, batch.b, batch.v, scores, strict=True):
                    to: dict[int, list[int]] = {}
                    met = left = 0
                    for leaf in tree.best_bins(own.tolist()):
                        if not lanes.sizes[leaf]:
                            continue
                        if left >= visits and met > k:
                            break
                        left, met = left + 1, met + lanes.sizes[leaf]
                        for lane in range(lanes.first[leaf], lanes.first[leaf] + lanes.n[leaf]):
                            to.setdefault(lane, []).append(leaf)
                    rows += [(lane, 1, a, b, 0, 0, False, leaves, v) for lane, leaves in to.items()]
                yield pd.DataFrame(rows, columns=PROBE.names)

        return asked.select("a", "b", "v").mapInPandas(walk, PROBE)

    def dealt(self) -> DataFrame:
        """The rows of the index with their lanes."""
        lanes = self.lanes

        @F.pandas_udf(T.IntegerType())
        def lane(leaf: pd.Series, row: pd.Series) -> pd.Series:
            first, n = np.array(lanes.first)[leaf], np.array(lanes.n)[leaf]
            return pd.Series((first + row.to_numpy() % n).astype(np.int32))

        return self.table.select(
            lane("leaf", F.abs(F.xxhash64("row") % 2**31)).alias("lane"), F.lit(0).alias("kind"), "a", "b", "row",
            F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"),
            F.array("leaf").alias("leaves"), "v",
        )

    def search(self, every: int = EVERY, target: float = TARGET) -> DataFrame:
        """query_id, rank, vec_id and score of the k nearest found of each row whose id ``every`` divides."""
        queries = self.rows.filter(F.col("vec_id") % every == 0)
        if not self.dims:
            empty = T.ArrayType(FOUND)
            return answers(queries.withColumn("near", F.array().cast(empty)), self.k)
        chosen = queries.select("a", "b").distinct()
        asked = written(self.table.filter("place = 1").join(chosen, ["a", "b"], "left_semi"))
        visits, _ = self.calibrate(asked, target)
        both = self.dealt().union(self.probes(asked, visits))
        k, n = self.k, 2 * self.lanes.count

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lane = None
            for batch in batches:
                for number, part in batch.groupby("lane", sort=True):
                    if lane is None or lane.number != number:
                        lane = Lane(int(number))
                    kinds = part.kind.to_numpy()
                    lane.add(part[kinds == 0])
                    asked = part[kinds == 1]
                    for at in range(0, len(asked), QUERY_TILE):
                        yield lane.best(asked.iloc[at : at + QUERY_TILE], k + 1)

        found = both.repartition(n, "lane").sortWithinPartitions("lane", "kind").mapInPandas(meet, FOUND)
        order = [F.desc("score"), F.asc("no_id"), F.asc("vec_id"), F.asc("row")]
        rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(*order))
        best = found.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
        near = best.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("rank", "row", "vec_id", "no_id", "score"))).alias("near"))
        return answers(queries.join(near, ["a", "b"]), k)


def answers(queries: DataFrame, k: int) -> DataFrame:
    """The lists of each query's class without the query's own row."""
    others = F.slice(F.filter("near", lambda x: x["row"] != F.col("row")), 1, k)
    rows = queries.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    vec_id = F.when(~F.col("x.no_id"), F.col("x.vec_id"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), vec_id.alias("vec_id"), F.col("x.score").alias("score"))


class Lane:
    """The rows of one lane, by leaf."""

    def __init__(self, number: int):
        self.number, self.parts, self.rows = number, [], None

    def add(self, part: pd.DataFrame) -> None:
        if len(part):
            leaf = np.array([x[0] for x in part.leaves])
            self.parts.append((leaf, part.row.to_numpy(), part.vec_id.to_numpy(), part.no_id.to_numpy(), matrix(part.v)))

    def sorted(self) -> None:
        if self.parts:
            leaf, *rest = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.argsort(leaf, kind="stable")
            self.rows = [x[order] for x in rest]
            names, starts = np.unique(leaf[order], return_index=True)
            self.slices = dict(zip(names.tolist(), zip(starts, [*starts[1:], len(leaf)], strict=True), strict=True))
            self.parts = []

    def best(self, asked: pd.DataFrame, k: int) -> pd.DataFrame:
        """The k best rows of the visited leaves for each query; equal scores by id."""
        self.sorted()
        if self.rows is None:
            return pd.DataFrame(columns=FOUND.names)
        row, vec_id, no_id, x = self.rows
        q = matrix(asked.v)
        scores = np.full((len(q), len(x)), -np.inf)
        visitors: dict[int, list[int]] = {}
        for i, leaves in enumerate(asked.leaves):
            for leaf in leaves.tolist():
                visitors.setdefault(leaf, []).append(i)
        with np.errstate(over="ignore", invalid="ignore"):
            for leaf, who in visitors.items():
                if leaf in self.slices:
                    low, high = self.slices[leaf]
                    scores[who, low:high] = np.nan_to_num(q[who] @ x[low:high].T)
            least = np.full(len(q), -np.inf)
            if len(x) > k:
                least = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
                least = least - 1e-9 * np.abs(q).max(axis=1) * np.abs(x).max() * x.shape[1]
            i, j = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            score = np.nan_to_num((q[i] * x[j]).sum(axis=1))  # summed alike for every pair
        order = np.lexsort((row[j], vec_id[j], no_id[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[keep], j[keep]
        return pd.DataFrame(
            {
                "a": asked.a.to_numpy()[i], "b": asked.b.to_numpy()[i], "row": row[j],
                "vec_id": vec_id[j], "no_id": no_id[j], "score": score[keep],
            }
        )


def search(vectors: DataFrame, k: int = TOP, every: int = EVERY, target: float = TARGET) -> DataFrame:
    return Index(vectors, k).search(every, target)
