"""Near-duplicates by min-max hashing: both ends of each permutation, bands, exact confirmation.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Each
of ``PERMUTATIONS`` permutations gives its smallest and its largest value, two
unbiased signature values for one hash evaluation, and ``ROWS`` values make a
band. At the threshold a pair shares none of the 40 bands with a chance of
3e-7, and the more similar it is the less.

1. Sketches: one pass over the texts. Equal sets become one class.
2. Buckets of equal bands; the member that sits in the largest buckets
   represents the bucket, and each member is paired with it (not with all).
3. Pairs whose signatures are alike (up to 5 standard deviations below the
   threshold) are compared on their full sets, a representative's members cut
   into bounded cells.
4. Where a representative's group still holds several components, its members
   are sorted out by the rarest shingles of their sets (a prefix filter, exact
   at the threshold): a passage that a family of texts shares is common, comes
   last in the order and brings nobody in. Members left that share a rare
   shingle with another component are compared with the group's others, in cells of
   two blocks: first by signature, then those with a partner on full sets,
   and only while they are not connected.
5. Components of the links; copies get those of their class.

Defined results: null or blank texts have an empty set and are linked with
nothing; rows that repeat an id are documents of their own; a null id never is
a component's smallest unless all its ids are null, then ``component_id`` is
null and ``kept`` true; an empty table gives no rows; other columns than
``doc_id`` and ``text`` are not read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import giving_back, ids_of, keyed, n_tasks, schema, utf8, written
from concord.llm.components import components

SHINGLE = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
PERMUTATIONS, ROWS = 80, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Equal signature bytes below which a pair is not compared: 0.75 less five deviations.
LEAST_EQUAL = int(2 * PERMUTATIONS * (0.75 - 5 * (0.75 * 0.25 / (2 * PERMUTATIONS)) ** 0.5))
#: Members compared with each other at once, on full sets and by signature.
BLOCK, SIGNED = 256, 2048

SKETCH = T.StructType(
    [
        *schema(row="long", doc_id="long", n="int", print="binary", signature="binary").fields,
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def constants(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    numbers = np.random.default_rng(20240229)
    draw = lambda size: numbers.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(SHINGLE + 1), draw(n), draw(n)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Sketcher:
    def __init__(self):
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        self.word, self.whole = xxh3_64_intdigest, xxh3_128_digest
        self.places, self.flips, self.factors = constants(PERMUTATIONS)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the shingles; only A-Z is lower-cased."""
        words = utf8(text).lower().split()
        h = np.array([self.word(w) for w in words], dtype=np.uint64)
        n = len(h) - SHINGLE + 1
        if not len(h):
            return h
        if n < 1:  # the whole sequence, told apart by its length
            return mixed((h * self.places[: len(h)]).sum(keepdims=True) + np.array([len(h)], np.uint64) * self.places[-1])
        return np.unique(mixed(sum(h[i : i + n] * self.places[i] for i in range(SHINGLE))))

    def signature(self, h: np.ndarray) -> np.ndarray:
        """Smallest and largest value of each permutation, side by side."""
        low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
        for i in range(0, len(h), 512):
            values = (h[i : i + 512, None] ^ self.flips) * self.factors
            low, high = np.minimum(low, values.min(0)), np.maximum(high, values.max(0))
        return np.stack([low, high], axis=1).ravel()

    def row(self, doc_id, text: str | None) -> tuple:
        h = self.shingles(text)
        if not len(h):
            return doc_id, 0, b"", b"", []
        signature = self.signature(h)
        bands = signature.reshape(BANDS, ROWS)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(ROWS):
            keys = mixed(keys ^ bands[:, i])
        low = ((signature >> np.uint64(24)) & np.uint64(255)).astype(np.uint8)
        return doc_id, len(h), self.whole(h.tobytes()), low.tobytes(), keys.astype(np.int64)


def sketches(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """One row per document with its number (by default its place), set size, fingerprint, signature bytes and bands."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher = Sketcher()
        for batch in batches:
            out = [(n, *sketcher.row(i, t)) for n, i, t in zip(batch["at"], ids_of(batch), batch.text, strict=True)]
            yield pd.DataFrame(out, columns=SKETCH.names).astype({"doc_id": "Int64"})

    row = F.monotonically_increasing_id() if row is None else row
    return docs.select(*keyed("text"), row.alias("at")).mapInPandas(giving_back(rows), SKETCH)


def stars(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's representative and a member, over all buckets."""
    bands = classes.select("node", F.explode("bands").alias("band"))
    sizes = bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = written(bands.join(sizes, "band"))
    weights = buckets.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = buckets.join(weights, "node").withColumn("order", F.struct(F.col("weight"), -F.col("node")))
    heads = weighed.groupBy("band").agg((-F.max("order")["col2"]).alias("a"))
    pairs = buckets.select("band", F.col("node").alias("b")).join(heads, "band")
    return pairs.filter("a <> b").select("a", "b").distinct()


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The full set of each node (node, doc_id, print)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher, done = Sketcher(), set()
        for batch in batches:
            out = []
            for node, known, text in zip(batch.node, batch["print"], batch.text, strict=True):
                if node in done:  # rows of one id meet in one task, or in parts of it: once each is enough
                    continue
                data = sketcher.shingles(text).tobytes()
                if sketcher.whole(data) == known:  # another row may share the id
                    out.append((node, data))
                    done.add(node)
            yield pd.DataFrame(out, columns=["node", "data"])

    nodes = nodes.select(F.col("doc_id").alias("id"), "node", "print")
    texts = docs.select("doc_id", "text").join(nodes, F.col("doc_id").eqNullSafe(F.col("id")))
    return texts.select("node", "print", "text").mapInPandas(giving_back(rows), schema(node="long", data="binary"))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = shared(a, b)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of signature bytes agree often enough to be compared on full sets."""
    return (a == b).sum(axis=1) >= LEAST_EQUAL


def bytes_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def plausible(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs whose signatures are alike."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.loc[alike(bytes_of(batch.s), bytes_of(batch.t)), ["a", "b"]]

    first = heads.select(F.col("node").alias("a"), F.col("signature").alias("s"))
    second = heads.select(F.col("node").alias("b"), F.col("signature").alias("t"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "s", "t").mapInPandas(giving_back(rows), LINKS)


CELL = ["a", "cell", "side", "node", "label", "data"]
LINKS = schema(a="long", b="long")


def in_cells(rows: DataFrame, work, result=LINKS) -> DataFrame:
    """Give the rows of each (a, cell), side by side, to ``work``: a few hundred rows at a time."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (row.a, row.cell) != key:
                    out += work(held) if held else []
                    key, held = (row.a, row.cell), []
                held.append(row)
            yield pd.DataFrame(out, columns=result.names)
        if held:
            yield pd.DataFrame(work(held), columns=result.names)

    rows = rows.select(CELL).repartition(n_tasks(rows.sparkSession), "a", "cell")
    return rows.sortWithinPartitions("a", "cell", "side", "node").mapInPandas(giving_back(cells), result)


def star_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough; cells of about ``BLOCK`` members and their representative."""

    def work(rows) -> list[tuple[int, int]]:
        head = np.frombuffer(rows[0].data, np.uint64)
        return [(rows[0].a, r.node) for r in rows[1:] if linked(head, np.frombuffer(r.data, np.uint64))]

    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cells"))
    none = [F.lit(0).cast("long").alias("label"), "data"]
    members = pairs.join(sets, F.col("b") == F.col("node")).join(counts, "a")
    members = members.select("a", F.pmod(F.xxhash64("b"), "cells").cast("int").alias("cell"), F.lit(1).alias("side"), "node", *none)
    heads = counts.join(sets, F.col("a") == F.col("node"))
    heads = heads.select("a", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(0).alias("side"), "node", *none)
    return in_cells(members.unionByName(heads), work)


def open_nodes(groups: DataFrame) -> DataFrame:
    """node and label of the members of groups (a, b, label) that hold several components: links may be missing there."""
    several = groups.groupBy("a").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return groups.join(several.select("a"), "a", "left_semi").select(F.col("b").alias("node"), "label").distinct()


def prefixes(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, label and shingle: the shingles of a set of which a similar set must hold one.

    Shingles are put in order from rare to common among ``nodes``. A set of n that
    shares 75% with another has one of its first ``n - ceil(0.75 n) + 1`` among that
    set's first ones. Shingles that no other node has come first and join nobody,
    so only those that are left of the prefix after them are given.
    """

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def unpacked(data: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(d, np.int64) for d in data])

    given = sets.join(nodes, "node").select("node", "label", (F.octet_length("data") / 8).cast("int").alias("n"), "data")
    entries = written(given.select("node", "label", "n", F.explode(unpacked("data")).alias("shingle")))
    common = entries.groupBy("shingle").agg(F.count("*").alias("times")).filter("times > 1")
    shared = entries.join(common, "shingle")
    held = shared.groupBy("node").agg(F.count("*").alias("shared"))
    first = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    room = shared.join(held, "node").withColumn("room", first - (F.col("n") - F.col("shared"))).filter("room > 0")
    place = F.row_number().over(Window.partitionBy("node").orderBy("times", "shingle"))
    return room.withColumn("place", place).filter("place <= room").select("node", "label", "shingle")


def in_blocks(groups: DataFrame, size: int) -> DataFrame:
    """Cells of two blocks of each group (a, b, label, left): members not reached by a, and all members."""
    others = F.count_if(F.col("a") != F.col("b")).alias("others")
    sizes = groups.groupBy("a").agg(F.count_if("left").alias("n_left"), F.count("*").alias("n_all"), others)
    sizes = sizes.filter("n_left > 0 and others > 1")  # a member and its representative are compared already
    sizes = sizes.select("a", *[F.ceil(F.col(c) / size).cast("int").alias(c) for c in ("n_left", "n_all")])
    groups = written(groups.join(sizes, "a"))
    block, other = F.pmod(F.xxhash64("b"), "n_left").cast("int"), F.pmod(F.xxhash64("b", F.lit(1)), "n_all").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    wide = lambda i, j: (i.cast("long") * 2**31 + j).alias("cell")
    left = groups.filter("left").withColumn("j", every("n_all"))
    left = left.select("a", wide(block, F.col("j")), F.lit(0).alias("side"), "b", "label")
    right = groups.withColumn("i", every("n_left"))
    return left.unionByName(right.select("a", wide(F.col("i"), other), F.lit(1).alias("side"), "b", "label"))


def rest_links(pairs: DataFrame, heads: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Links that the stars have missed: in each representative's group, members of other components with all.

    Only members whose rare shingles occur in another component take part.
    """

    def partners(rows) -> list[tuple[int, int]]:
        """Members that are alike in signature to one of another component."""
        signatures, names = bytes_of([r.data for r in rows]), np.array([r.label for r in rows])
        found = set()
        for i in [i for i, r in enumerate(rows) if r.side == 0]:
            near = np.flatnonzero(alike(signatures, signatures[i]) & (names != names[i]))
            if len(near):
                found |= {rows[i].node, *(rows[j].node for j in near)}
        return [(rows[0].a, node) for node in found]

    def work(rows) -> list[tuple[int, int]]:
        """Links that connect what is not connected yet."""
        out, root = [], {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x] = root.get(root[x], root[x])
            return x

        data = [np.frombuffer(r.data, np.uint64) for r in rows]
        for i in [i for i, r in enumerate(rows) if r.side == 0]:
            for j in range(len(rows)):
                if find(rows[i].label) != find(rows[j].label) and linked(data[i], data[j]):
                    out.append((rows[i].node, rows[j].node))
                    root[find(rows[i].label)] = find(rows[j].label)
        return out

    groups = pairs.unionByName(pairs.select("a", F.col("a").alias("b")).distinct())
    groups = groups.join(labels, F.col("b") == F.col("node"), "left").select("a", "b", F.coalesce("label", "b").alias("label"))
    entries = written(prefixes(open_nodes(groups), sets))
    several = entries.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    able = written(entries.join(several, "shingle", "left_semi").select(F.col("node").alias("able")).distinct())
    own = groups.filter("a = b").select("a", F.col("label").alias("reached"))
    groups = groups.join(own, "a").withColumn("left", F.col("label") != F.col("reached")).drop("reached")
    groups = groups.join(able, F.col("b") == F.col("able"), "left_semi")
    cells = in_blocks(groups, SIGNED).join(heads.select("node", F.col("signature").alias("data")), F.col("b") == F.col("node"))
    kept = in_cells(cells, partners).distinct()
    cells = in_blocks(groups.join(written(kept), ["a", "b"], "left_semi"), BLOCK).join(sets, F.col("b") == F.col("node"))
    return in_cells(cells, work)


def link_documents(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_shingles, component_id and whether it stays.

    Who joins on ``row`` afterwards gives a stored column: places differ from scan to scan.
    """
    found = written(sketches(docs, row))
    some = found.filter("n > 0")
    classes = some.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "n")).alias("first"))
    classes = classes.select("print", F.col("first.row").alias("node"), F.col("first.doc_id").alias("doc_id"), F.col("first.n").alias("n"))
    classes = written(classes)
    heads = some.select(F.col("row").alias("node"), "bands", "signature").join(classes, "node")
    heads = written(heads)
    pairs = written(stars(heads))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = written(full_sets(docs, classes.join(nodes, "node")))
    links = written(star_links(written(plausible(pairs, heads)), sets))
    more = written(rest_links(pairs, heads, sets, components(links)))
    labels = components(links.unionByName(more))
    labels = classes.join(labels, "node", "left").select("print", F.coalesce("label", "node").alias("label"))
    placed = found.join(labels, "print", "left").select(
        "row", "doc_id", "n", F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("row")).alias("label")
    )
    placed = written(placed)
    smallest = placed.groupBy("label").agg(
        F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("one")
    )
    return placed.join(smallest, "label").select(
        "row",
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
        (F.col("row") == F.col("one")).alias("stays"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    return link_documents(docs).select("doc_id", "n_shingles", "component_id", "kept")
