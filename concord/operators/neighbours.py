"""Nearest neighbours by L2 (exact and hashed), class centroids and the nearest-centroid classifier.

Exact search takes one of two ways, by the number of queries. Up to ``FEW``
queries go to the tasks, and each task scans the vectors it reads: nothing is
shuffled but the best rows. More queries go through pivots: vectors are grouped
by their nearest pivot, and a query visits its own group first and then only
groups that the triangle inequality cannot rule out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.operators import cells
from concord.operators.cells import CELL, RANK_DECIMALS, VECTOR, doubles, matrix_of, nearest_rows

#: Queries, and bytes of class centres, that are taken to the tasks; beyond them rows meet in cells.
FEW, CENTRE_BYTES = 256, 64 << 20

#: Pivots of exact search, each a vector of the table; held by the driver and the tasks.
PIVOTS = 128

#: Centres up to this many are compared without groups.
DIRECT = 256


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector per label; partial sums are combined map-side, one row per label and task."""
    mean = Summarizer.mean(array_to_vector(F.col(vector))).alias("mean")
    return vectors.groupBy(label).agg(mean).select(label, vector_to_array("mean").alias(vector))


def _given(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.dropna(subset=[key, vector]).select(F.col(key).alias("key"), doubles(vector).alias("v"))


def _asked(queries: DataFrame, carry: Sequence[str], vector: str) -> DataFrame:
    """``query``, the columns to be carried along, and ``v``."""
    return queries.dropna(subset=[vector]).select(F.struct(*carry).alias("query"), doubles(vector).alias("v"))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    query_key: str = "query_id",
) -> DataFrame:
    """Exact ``k`` nearest vectors per query: rank, squared distance and distance. Queries may be any number of rows."""
    found = _search(_given(vectors, key, vector), _asked(queries, [query_key], vector), k)
    return _result(found, [query_key], key)


def nearest_many(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    query_key: str = "query_id",
    pivots: int = PIVOTS,
) -> DataFrame:
    """As ``nearest``, through pivots whatever the number of queries."""
    index = PivotIndex(_given(vectors, key, vector), pivots)
    return _result(index.search(_asked(queries, [query_key], vector), k), [query_key], key)


def _result(found: DataFrame, carry: Sequence[str], key: str) -> DataFrame:
    named = [F.col(f"query.`{c}`").alias(c) for c in carry]
    return found.select(*named, F.col("key").alias(key), "distance_sq", "rank", F.sqrt("distance_sq").alias("distance"))


def _search(given: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    few = asked.limit(FEW + 1).toArrow()
    return _scan(given, few, asked.schema["query"], k) if few.num_rows <= FEW else PivotIndex(given).search(asked, k)


def _scan(given: DataFrame, asked: pa.Table, query: T.StructField, k: int) -> DataFrame:
    """A few queries against all vectors, where the vectors are."""
    points, carried = matrix_of(asked["v"]), asked["query"].combine_chunks()
    key = given.schema["key"]
    found = T.StructType([T.StructField("place", T.LongType()), query, key, T.StructField("distance_sq", T.DoubleType())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            keys = batch["key"]
            i, j, distance = nearest_rows(points, matrix_of(batch["v"]), cells.positions(keys), k)
            rows = pa.table({"i": i, "near": distance.round(RANK_DECIMALS), "key": keys.take(pa.array(j)), "distance": distance})
            held = rows if held is None else pa.concat_tables([held, rows])
            held = held.sort_by([(c, "ascending") for c in ("i", "near", "key")])
            owner = held["i"].to_numpy()
            held = held.filter(pa.array(np.arange(len(owner)) - np.searchsorted(owner, owner) < k))
        if held is not None and held.num_rows:
            place = held["i"].combine_chunks()
            columns = [place, carried.take(place), held["key"].combine_chunks(), held["distance"].combine_chunks()]
            yield pa.RecordBatch.from_arrays(columns, found.names)

    if not asked.num_rows:
        return cells.ranked(given.sparkSession.createDataFrame([], found), ["place"], k)
    return cells.ranked(given.mapInArrow(best, found), ["place"], k)


def _named(asked: DataFrame) -> DataFrame:
    """Queries by content: two hashes for a name, how often a query occurs, and the query once."""
    names = {"p": F.xxhash64("query", "v"), "q": F.xxhash64(F.lit(1), "query", "v")}
    once = [F.first("query").alias("query"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n")]
    named = asked.withColumns(names).groupBy("p", "q").agg(*once)
    return named.select(F.struct("p", "q", "n", F.col("query").alias("own")).alias("query"), "v")


def _unnamed(found: DataFrame, k: int) -> DataFrame:
    """Ranked rows of named queries, as often as the query occurs."""
    rows = cells.ranked(found.withColumns({"p": F.col("query.p"), "q": F.col("query.q")}), ["p", "q"], k)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("query.n")))
    return rows.withColumn("time", times).select(F.col("query.own").alias("query"), "key", "distance_sq", "rank")


class PivotIndex:
    """Vectors (``key, v``) grouped by the nearest of a few pivots, for exact search of many queries.

    Pivots are the ``n`` vectors of least hash. A group is known by its
    size and by the range of its members' distances from the pivot. For a query
    at distance d of a group's pivot, no member is nearer than the gap between d
    and that range, nor nearer than the plane between that pivot and the
    query's own; groups beyond the k-th distance found so far are not visited.
    In a visited group the rows outside the same range are skipped.
    """

    def __init__(self, given: DataFrame, n: int = PIVOTS):
        sample = given.select("v").orderBy(F.xxhash64("v"), "v").limit(n).toArrow()
        self.pivots = pivots = np.unique(matrix_of(sample["v"]), axis=0)

        @F.pandas_udf("g int, at double")
        def group(v: pd.Series) -> pd.DataFrame:
            distance = cells.squared(np.stack(v.to_numpy()), pivots)
            own = distance.argmin(axis=1)
            points = np.stack(v.to_numpy()) - pivots[own]
            return pd.DataFrame({"g": own.astype(np.int32), "at": np.sqrt((points * points).sum(axis=1))})

        self.given = given
        if not len(pivots):
            return
        self.rows = given.select("key", "v", group("v").alias("of")).select("key", "v", "of.g", "of.at")
        stats = {r.g: r for r in self.rows.groupBy("g").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).collect()}
        self.sizes = np.array([stats[g].n if g in stats else 0 for g in range(len(pivots))])
        self.low = np.array([stats[g].low if g in stats else 0.0 for g in range(len(pivots))])
        self.high = np.array([stats[g].high if g in stats else 0.0 for g in range(len(pivots))])
        self.between = np.sqrt(cells.squared(pivots, pivots))

    def cell(self, salt: Column) -> Column:
        return F.col("g") * F.lit(1 << 32) + salt

    def salts(self) -> Column:
        """Cells of a group."""
        return F.element_at(F.lit([max(1, -(-int(n) // CELL)) for n in self.sizes]), F.col("g") + 1)

    def home(self, k: int):
        """Groups around a query, nearest pivots first, that hold at least ``k`` vectors."""
        pivots, sizes = self.pivots, self.sizes

        @F.pandas_udf("array<struct<g: int, at: double>>")
        def near(v: pd.Series) -> pd.Series:
            return pd.Series([_closest(d, pivots, sizes, k) for d in np.sqrt(cells.squared(np.stack(v.to_numpy()), pivots))])

        return near

    def others(self, k: int):
        """Groups that can hold a vector within reach, without those of ``home``."""
        pivots, sizes, low, high, between = self.pivots, self.sizes, self.low, self.high, self.between

        @F.pandas_udf("array<struct<g: int, at: double>>")
        def within(v: pd.Series, reach: pd.Series) -> pd.Series:
            points = np.stack(v.to_numpy())
            out = []
            spare = cells.slack((points * points).sum(axis=1), (pivots * pivots).sum(axis=1))
            for d, r in zip(np.sqrt(cells.squared(points, pivots)), reach, strict=True):
                own = int(d.argmin())
                plane = np.divide(d**2 - d[own] ** 2, 2 * between[own], out=np.zeros(len(d)), where=between[own] > 0)
                least = np.maximum(np.maximum(d - high, low - d), plane)
                may = (least <= 0) | (least**2 <= r + 2 * spare)
                seen = {x["g"] for x in _closest(d, pivots, sizes, k)}
                out.append([{"g": int(g), "at": float(d[g])} for g in np.flatnonzero(may & (sizes > 0)) if g not in seen])
            return pd.Series(out)

        return within

    def visits(self, asked: DataFrame, groups: Column, reach: Column) -> DataFrame:
        """A row for each query and group."""
        rows = asked.select("query", "v", reach.alias("reach"), F.explode(groups).alias("to"))
        return rows.select("query", "v", "reach", "to.g", "to.at")

    def met(self, visits: DataFrame, k: int) -> DataFrame:
        own = self.rows.select(self.cell(cells.salted("key", self.salts())).alias("cell"), "at", "key", "v")
        salt = F.explode(F.sequence(F.lit(0), self.salts() - 1)).alias("salt")
        asked = visits.select("query", "v", "reach", "at", "g", salt)
        asked = asked.select(self.cell(F.col("salt")).alias("cell"), "at", "reach", "query", "v")
        return cells.meet(own, asked, k)

    def first_visits(self, named: DataFrame, k: int) -> DataFrame:
        return self.visits(named, self.home(k)("v"), F.lit(float("inf")))

    def later_visits(self, named: DataFrame, first: DataFrame, k: int) -> DataFrame:
        """Visits to the groups that the k-th distance found so far does not rule out."""
        best = cells.ranked(first.select("query.p", "query.q", "key", "distance_sq"), ["p", "q"], k)
        reach = best.groupBy("p", "q").agg(F.max("distance_sq").alias("reach"))
        known = named.withColumns({"p": F.col("query.p"), "q": F.col("query.q")}).join(reach, ["p", "q"])
        return self.visits(known, self.others(k)("v", "reach"), F.col("reach"))

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        """``query, key, distance_sq, rank`` of the ``k`` nearest vectors of each query."""
        named = _named(asked)
        if not len(self.pivots):
            rows = T.StructType([asked.schema["query"], self.given.schema["key"], T.StructField("distance_sq", T.DoubleType())])
            nothing = asked.sparkSession.createDataFrame([], rows)
            return nothing.withColumn("rank", F.lit(0).cast("bigint"))
        first = self.met(self.first_visits(named, k), k)
        later = self.met(self.later_visits(named, first, k), k)
        return _unnamed(first.union(later), k)


def _closest(distances: np.ndarray, pivots: np.ndarray, sizes: np.ndarray, k: int) -> list[dict]:
    """The nearest groups that together hold ``k`` vectors."""
    out, held = [], 0
    for g in np.argsort(distances, kind="stable"):
        if sizes[g]:
            out.append({"g": int(g), "at": float(distances[g])})
            held += sizes[g]
        if held >= k:
            break
    return out


def nearest_lsh(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    query_key: str = "query_id",
    tables: int = 8,
    width: int = 3,
    length: float = 1.0,
    reach: int = 2,
    target: float = 0.95,
    sample: int = 64,
    seed: int = 42,
) -> DataFrame:
    """Approximate ``k`` nearest vectors of each query: random projections choose, exact distances rank.

    Both sides are hashed once: in each of ``tables`` tables a vector falls
    into the bucket given by ``width`` projections, cut into steps of ``length``
    times the spread of the data. A query probes buckets of all tables, up to
    ``reach`` steps aside along each projection, in order of how far it is from
    them. How many it probes is the least number that finds ``target`` of the
    true neighbours of ``sample`` queries; only those come to the driver. Large
    buckets are spread over several cells. A vector found in several tables
    counts once, by its key; buckets may hold fewer than ``k`` vectors.
    """
    given, asked = _given(vectors, key, vector), _asked(queries, [query_key], vector)
    total = F.aggregate(vector_to_array(Summarizer.variance(array_to_vector(F.col("v")))), F.lit(0.0), lambda a, x: a + x)
    spread = F.greatest(F.coalesce(given.agg(F.sqrt(total)).scalar(), F.lit(0.0)), F.lit(1e-12)) * F.lit(length)
    hashing = Hashing(tables, width, reach, seed)
    hashed = given.withColumn("buckets", hashing.buckets()("v", spread))
    named = _named(asked).withColumn("probes", hashing.probes()("v", spread))

    some = asked.orderBy(F.xxhash64("query", "v"), "query").limit(sample)
    true = _scan(given, some.toArrow(), asked.schema["query"], k)
    own = some.withColumn("probes", hashing.probes()("v", spread)).select("query", "probes").distinct()
    places = F.transform("buckets", lambda b: F.array_position("probes", b))
    place = F.array_min(F.filter(places, lambda p: p > 0))
    needed = true.select("query", "key").join(own, "query").join(hashed.select("key", "buckets"), "key")
    never = F.lit(hashing.n_probes).cast("bigint")
    upto = needed.agg(F.percentile_approx(F.coalesce(place, never), target, 10_000)).scalar()
    upto = F.coalesce(upto, never).cast("int")

    rows = hashed.select("key", "v", F.explode("buckets").alias("bucket"))
    probes = named.select("query", "v", F.explode(F.slice("probes", F.lit(1), upto)).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / CELL).cast("int")
    large = sizes.filter(F.col("size") > CELL)
    own_part = cells.salted("key", F.coalesce(parts, F.lit(1)))
    rows = rows.join(large, "bucket", "left").select(
        F.xxhash64("bucket", own_part.cast("int")).alias("cell"), F.lit(0.0).alias("at"), "key", "v"
    )
    probes = probes.join(sizes, "bucket").select("query", "v", "bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    probes = probes.select(
        F.xxhash64("bucket", "part").alias("cell"), F.lit(0.0).alias("at"), F.lit(float("inf")).alias("reach"), "query", "v"
    )
    found = cells.meet(rows, probes, k)
    once = found.groupBy("query.p", "query.q", "key").agg(F.first("query").alias("query"), F.min("distance_sq").alias("distance_sq"))
    return _result(_unnamed(once.select("query", "key", "distance_sq"), k), [query_key], key)


class Hashing:
    """Buckets of vectors and probe sequences of queries, by random projections."""

    def __init__(self, tables: int, width: int, reach: int, seed: int):
        self.tables, self.width, self.seed = tables, width, seed
        steps = np.arange(-reach, reach + 1)
        self.moves = np.stack(np.meshgrid(*[steps] * width, indexing="ij"), axis=-1).reshape(-1, width)
        self.n_probes = tables * len(self.moves)

    def steps(self, v: pd.Series, spread: pd.Series) -> np.ndarray:
        """Projections in steps: vectors by tables by projections of a table."""
        matrix = np.stack(v.to_numpy())
        lines = np.random.default_rng(self.seed).normal(size=(matrix.shape[1], self.tables * self.width))
        shifts = np.random.default_rng(self.seed + 1).uniform(size=self.tables * self.width)
        return (matrix @ lines / spread.to_numpy()[:, None] + shifts).reshape(len(matrix), self.tables, self.width)

    def names(self, corners: np.ndarray) -> np.ndarray:
        """A number for each bucket; the last axis holds its steps, the one that counts tables is the second."""
        shape = [1, self.tables] + [1] * (corners.ndim - 3)
        table = np.arange(1, self.tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        name = np.broadcast_to(table.reshape(shape), corners.shape[:-1]).copy()
        for axis in range(self.width):
            name = (name ^ corners[..., axis].astype(np.uint64)) * np.uint64(0x2545F4914F6CDD1D)
            name ^= name >> np.uint64(31)
        return name.view(np.int64)

    def buckets(self):
        @F.pandas_udf("array<long>")
        def buckets(v: pd.Series, spread: pd.Series) -> pd.Series:
            return pd.Series(list(self.names(np.floor(self.steps(v, spread)).astype(np.int64))))

        return buckets

    def probes(self):
        @F.pandas_udf("array<long>")
        def probes(v: pd.Series, spread: pd.Series) -> pd.Series:
            out = []
            for low in range(0, len(v), 256):
                steps = self.steps(v.iloc[low : low + 256], spread.iloc[low : low + 256])
                corner = np.floor(steps)
                inside = (steps - corner)[:, :, None, :]
                gap = np.where(self.moves > 0, self.moves - inside, np.where(self.moves < 0, inside - self.moves - 1, 0.0))
                away = (gap * gap).sum(axis=-1).reshape(len(steps), -1)
                names = self.names(corner.astype(np.int64)[:, :, None, :] + self.moves).reshape(len(steps), -1)
                out += list(np.take_along_axis(names, np.argsort(away, axis=1, kind="stable"), axis=1))
            return pd.Series(out)

        return probes


class Centres:
    """Class centres by the order of their labels, in groups around some of them, for pruned search.

    Centres are put in order of their norms, and every so-manieth is a pivot;
    the others join the nearest pivot. A group is skipped for a vector if the
    triangle inequality puts all its centres further off than the best so far,
    from the vector's distance to the pivot, or from the distance between the
    best centre and the pivot: a centre more than twice as far from the best one
    as the vector is cannot win.
    """

    def __init__(self, points: np.ndarray):
        self.points, self.compared = points, 0
        by_norm = np.argsort((points * points).sum(axis=1), kind="stable")
        n = 1 if len(points) <= DIRECT else int(np.sqrt(len(points)))
        pivots = points[np.unique(by_norm[np.linspace(0, len(points) - 1, n).astype(int)])]
        own = np.concatenate([cells.squared(points[a : a + 4096], pivots).argmin(axis=1) for a in range(0, len(points), 4096)])
        used = np.unique(own)
        self.pivots, self.groups = pivots[used], [np.flatnonzero(own == g) for g in used]
        self.from_pivot = np.sqrt(cells.squared(points, self.pivots))
        self.radius = np.array([self.from_pivot[members, g].max() for g, members in enumerate(self.groups)])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and squared distance of each vector's nearest centre, the first of equal ones."""
        to_pivot = np.sqrt(cells.squared(x, self.pivots))
        home = to_pivot.argmin(axis=1)
        best, distance = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)

        def compare(g: int, rows: np.ndarray) -> None:
            members = self.groups[g]
            self.compared += len(rows) * len(members)
            i, j, d = nearest_rows(x[rows], self.points[members], members, 1)
            rows, found = rows[i], members[j]
            new, old = d.round(RANK_DECIMALS), distance[rows].round(RANK_DECIMALS)
            wins = (new < old) | ((new == old) & (found < best[rows]))
            best[rows[wins]], distance[rows[wins]] = found[wins], d[wins]

        for g in np.unique(home):
            compare(g, np.flatnonzero(home == g))
        spare = cells.slack((x * x).sum(axis=1), (self.points * self.points).sum(axis=1))
        for g in range(len(self.groups)):
            near = np.sqrt(distance + 2 * spare)
            least = np.maximum(to_pivot[:, g], self.from_pivot[best, g] - near) - self.radius[g]
            rows = np.flatnonzero((home != g) & (least <= near))
            if len(rows):
                compare(g, rows)
        return best, distance


def nearest_centroid(
    vectors: DataFrame,
    centres: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``key, truth, prediction, distance_sq``: each vector's nearest class centre, ties to the smaller label.

    Centres of up to ``CENTRE_BYTES`` go to the tasks, where each vector is
    compared with few groups of them and does not move. More centres, of
    which there may be any number, are searched as vectors, the vectors
    being the queries.
    """
    given = _given(centres, label, vector)
    fits = given.agg(F.coalesce(F.sum(F.size("v") * 8), F.lit(0)) <= CENTRE_BYTES).scalar()
    held = given.filter(fits).toArrow()
    if not held.num_rows:
        found = _search(given, _asked(vectors, [key, label], vector), 1)
        named = [F.col(f"query.`{key}`").alias(key), F.col(f"query.`{label}`").alias("truth")]
        return found.select(*named, F.col("key").alias("prediction"), "distance_sq")
    held = held.sort_by("key")
    labels, index = held["key"].combine_chunks(), Centres(matrix_of(held["v"]))
    result = T.StructType(
        [
            T.StructField(key, vectors.schema[key].dataType),
            T.StructField("truth", vectors.schema[label].dataType),
            T.StructField("prediction", centres.schema[label].dataType),
            T.StructField("distance_sq", T.DoubleType()),
        ]
    )

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                best, distance = index.nearest(matrix_of(part["v"]))
                columns = [part["key"], part["truth"], labels.take(pa.array(best)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, result.names)

    rows = vectors.dropna(subset=[vector])
    return rows.select(F.col(key).alias("key"), F.col(label).alias("truth"), doubles(vector).alias("v")).mapInArrow(classify, result)
