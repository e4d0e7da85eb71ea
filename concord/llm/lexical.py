"""Ranked lexical search: dense blocked matrix products of item weights and document impacts.

Items are packed into tiles of bounded size, each with a compact vocabulary of
its own. Document texts are cut into terms where they lie and never move: a
first pass counts documents by term, a second one goes over the texts in tiles
of ``DOC_TILE`` documents. Each document tile meets each item tile: term counts
become a dense matrix of impacts (documents by vocabulary), which is multiplied
by the dense matrix of term weights (vocabulary by items) with BLAS in float64,
``CHUNK`` terms at a time. Weights and impacts are integers, and a chunk's sums
stay below 2^53, so products are exact; chunks are added up as 64-bit integers.

A tile's scores pass a threshold for each item, the k-th best score that its
task has seen so far. Scores equal to it pass too, and the id decides among
them, so ties are never cut by chance. Each task gives k rows an item; the best
of all tasks are ranked in two steps.

Memory holds one document tile, the item tiles of a task up to ``HELD_BYTES``
(others are read again from the shared folder) and k rows for each item of the
tiles held. Tiles are read, never broadcast, so items may be any number.

Defined results: null, empty and blank texts have no terms; an item without
terms, or none that a document holds, gives no rows; a null ``doc_id`` comes
after all ids in ties and reads back as null; rows that repeat a ``doc_id`` are
documents of their own, rows that repeat an ``item_id`` items of their own; a
term of weight 0 adds nothing; empty tables give no rows; only the named columns
are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import ids_of, keyed, open_store, schema, shared_folder, text_or_empty, utf8, written

#: Terms are maximal runs of ASCII letters, digits and anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TOP = 50
DOC_TILE, ITEM_TILE, TILE_TERMS, CHUNK = 256, 256, 16_384, 2048
#: Words of a document tile, beyond which it gets no further document.
TILE_WORDS = 1 << 19
#: Terms counted by a task before it gives its counts away.
COUNTED = 200_000
HELD_BYTES = 64 << 20
#: Scores of a tile are below weight * impact * terms: 2^53 leaves room for weights up to 2^22.
IMPACT = 10**9

COUNTS = schema(term="string", n="long", total="long")
TILE = schema(tile="long", items="binary", sizes="binary", terms="string")
FOUND = schema(item="long", doc_id="long", score="long")

#: Bytes of terms as they are, capital letters as small ones, all others as a space.
TABLE = bytes(
    c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256)
)


def terms(text: str | None) -> list[bytes]:
    return utf8(text).translate(TABLE).split()


def decoded(term: bytes) -> str:
    return term.decode("utf-8", "surrogatepass")


def counted(docs: DataFrame) -> DataFrame:
    """Documents by term; the empty term has the documents with any term, and the terms of all."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holds, n, total = Counter(), 0, 0
        for batch in batches:
            for text in batch.text:
                own = terms(text)
                if own:
                    holds.update(set(own))
                    n, total = n + 1, total + len(own)
                if len(holds) >= COUNTED:
                    yield pd.DataFrame([(decoded(t), c, 0) for t, c in holds.items()], columns=COUNTS.names)
                    holds.clear()
        rows = [(decoded(t), c, 0) for t, c in holds.items()]
        yield pd.DataFrame([*rows, ("", n, total)], columns=COUNTS.names)

    sums = docs.select("text").mapInPandas(tally, COUNTS).groupBy("term")
    return sums.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def tiled(items: DataFrame) -> DataFrame:
    """Items packed into tiles: their numbers, how many terms each has, and the terms, joined by spaces."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def tile() -> pd.DataFrame:
            numbers = np.array([i for i, _ in held], "<i8").tobytes()
            sizes = np.array([len(t) for _, t in held], "<i8").tobytes()
            return pd.DataFrame([(held[0][0], numbers, sizes, " ".join(t for _, ts in held for t in ts))], columns=TILE.names)

        for batch in batches:
            for item, own in zip(batch.item.tolist(), batch.terms, strict=True):
                if held and (len(held) == ITEM_TILE or size + len(own) > TILE_TERMS):
                    yield tile()
                    held, size = [], 0
                held.append((item, list(own)))
                size += len(own)
        if held:
            yield tile()

    lower = F.translate(text_or_empty(), UPPER, LOWER)
    own = F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))
    return items.select("item", own.alias("terms")).filter(F.size("terms") > 0).mapInPandas(pack, TILE)


class ItemTile:
    """Items of a tile with the dense matrix of their term weights."""

    def __init__(self, items: bytes, sizes: bytes, terms: str, holds: list, n_docs: int):
        self.items = np.frombuffer(items, "<i8")
        owner = np.repeat(np.arange(len(self.items)), np.frombuffer(sizes, "<i8"))
        documents = {c["term"]: c["n"] for c in holds}
        listed = terms.split(" ")
        known = [(i, t) for i, t in zip(owner.tolist(), listed, strict=True) if t in documents]
        self.column = {utf8(t): c for c, t in enumerate(dict.fromkeys(t for _, t in known))}
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in documents.items()}
        self.weights = np.zeros((len(self.column), len(self.items)))
        for i, t in known:
            self.weights[self.column[utf8(t)], i] = weight[t]
        self.bytes = self.weights.nbytes + 200 * len(self.column)


class Tiles:
    """The item tiles in a folder, each with the best documents so far; the first ones stay in memory."""

    def __init__(self, folder: str, n_docs: int, k: int):
        self.folder, self.n_docs, self.k = folder, n_docs, k
        self.held: dict[int, tuple[ItemTile, Best]] = {}
        self.size, self.whole = 0, False

    def __iter__(self) -> Iterator[tuple[ItemTile, Best, bool]]:
        """Tile, its best documents, and whether both stay."""
        if self.whole:
            yield from ((*pair, True) for pair in self.held.values())
            return
        self.whole = True
        for row in self.rows():
            pair = self.held.get(row["tile"])
            if pair is None:
                tile = ItemTile(row["items"], row["sizes"], row["terms"], row["holds"], self.n_docs)
                pair = tile, Best(len(tile.items), self.k)
                if self.size < HELD_BYTES:
                    self.held[row["tile"]] = pair
                    self.size += tile.bytes
            stays = row["tile"] in self.held
            self.whole &= stays
            yield *pair, stays

    def rows(self) -> Iterator[dict]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, place = open_store(self.folder)
        files = system.get_file_info(fs.FileSelector(place, recursive=True))
        for path in sorted(f.path for f in files if f.path.endswith(".parquet")):
            with system.open_input_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=1):
                    yield from batch.to_pylist()


class DocTile:
    """Terms of a few documents, numbered within the tile."""

    def __init__(self, ids: list[int | None], texts: list[list[bytes]], n_docs: int, n_terms: int):
        self.ids = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        self.no_id = np.array([i is None for i in ids])
        table = defaultdict(count().__next__)
        sizes = [len(t) for t in texts]
        self.names = np.fromiter((table[t] for own in texts for t in own), dtype=np.int64, count=sum(sizes))
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        self.vocabulary = list(table)
        self.longness = np.array([50 + 50 * n * n_docs // max(n_terms, 1) for n in sizes], dtype=np.int64)

    def scores(self, tile: ItemTile) -> np.ndarray:
        """Exact scores, documents by items."""
        n, width = len(self.ids), len(tile.column)
        out = np.zeros((n, len(tile.items)), dtype=np.int64)
        place = np.fromiter(map(tile.column.get, self.vocabulary, repeat(-1)), dtype=np.int64, count=len(self.vocabulary))
        column = place[self.names]
        inside = column >= 0
        column, owner = column[inside], self.owner[inside]
        for low in range(0, width, CHUNK):
            high = min(low + CHUNK, width)
            part = (column >= low) & (column < high)
            times = np.bincount(owner[part] * (high - low) + column[part] - low, minlength=n * (high - low))
            at = np.flatnonzero(times)
            impact = np.zeros(n * (high - low))
            impact[at] = IMPACT * times[at] // (1000 * times[at] + 20 * self.longness[at // (high - low)])
            impact = impact.reshape(n, -1)
            used = impact.any(axis=0)
            out += (impact[:, used] @ tile.weights[low:high][used]).astype(np.int64)
        return out


class Best:
    """The k best documents so far of each item of a tile."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.ones(n, dtype=np.int64)
        self.rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))

    def take(self, scores: np.ndarray, docs: DocTile) -> None:
        doc, item = np.nonzero(scores >= self.least)
        if not len(doc):
            return
        new = (item, scores[doc, item], docs.no_id[doc], docs.ids[doc])
        item, score, no_id, ids = (np.concatenate(x) for x in zip(self.rows, new, strict=True))
        order = np.lexsort((ids, no_id, -score, item))
        item = item[order]
        first = np.searchsorted(item, item, side="left")
        rank = np.arange(len(item)) - first
        order, item, rank = order[rank < self.k], item[rank < self.k], rank[rank < self.k]
        self.rows = (item, score[order], no_id[order], ids[order])
        full = rank == self.k - 1
        self.least[item[full]] = self.rows[1][full]

    def found(self, tile: ItemTile) -> pd.DataFrame:
        item, score, no_id, ids = self.rows
        ids = pd.Series(ids).astype("Int64").mask(no_id)
        return pd.DataFrame({"item": tile.items[item], "doc_id": ids, "score": score})


def doc_tiles(batches: Iterator[pd.DataFrame], n_docs: int, n_terms: int) -> Iterator[DocTile]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(ids_of(batch), batch.text, strict=True):
            if own := terms(text):
                ids.append(doc_id)
                texts.append(own)
                size += len(own)
            if len(ids) == DOC_TILE or size >= TILE_WORDS:
                yield DocTile(ids, texts, n_docs, n_terms)
                ids, texts, size = [], [], 0
    if ids:
        yield DocTile(ids, texts, n_docs, n_terms)


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    numbered = written(items.select("item_id", "text", F.monotonically_increasing_id().alias("item")))
    tiles = written(tiled(numbered))
    asked = tiles.select("tile", F.explode(F.array_distinct(F.split("terms", " "))).alias("term"))
    vocabulary = asked.select("term").union(tiles.sparkSession.createDataFrame([("",)], "term string")).distinct()
    counts = written(counted(docs).join(vocabulary, "term", "left_semi"))
    totals = counts.filter("term = ''").first()
    n_docs, n_terms = (totals["n"], totals["total"]) if totals else (0, 0)
    holds = asked.join(counts, "term").groupBy("tile").agg(F.collect_list(F.struct("term", "n")).alias("holds"))
    folder = shared_folder(docs.sparkSession)
    tiles.join(holds, "tile").write.parquet(folder)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tiles = Tiles(folder, n_docs, k)
        for docs in doc_tiles(batches, n_docs, n_terms):
            for tile, rows, stays in tiles:
                rows.take(docs.scores(tile), docs)
                if not stays:
                    yield rows.found(tile)
        for tile, rows in tiles.held.values():
            yield rows.found(tile)

    found = docs.select(*keyed("text")).mapInPandas(best, FOUND)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id", "score"), F.lit(32))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
