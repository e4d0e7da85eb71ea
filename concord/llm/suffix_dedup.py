"""Suffix-array dedup: bytes inside any 100-byte string that also starts earlier.

Prefix doubling names positions by the string of length h that starts there;
names of pairs (position, position + h) are names for 2h, and positions whose
name is unique drop out. Only equality counts here, so fingerprints serve as
names, and only positions that can still have a partner are named again:

1. Of the 20-byte strings inside each 100-byte string the one of least hash
   is its anchor (the leftmost of equal ones). Equal 100-byte strings have
   their anchor at the same place, so only anchors, about one in forty
   positions, are named and shuffled at first.
2. Anchors are sorted by the name of their 20 bytes and of their whole context
   (all the 100-byte strings that they stand for). All but the first of an
   equal context are repeats. Firsts whose 20 bytes are unique drop out, and
   so do those that share neither the 60 bytes from the anchor on nor the 60
   that reach 20 past it: one of these lies in each of the 100-byte strings.
3. The positions of what is left get names of 100 bytes, from two of 50, and
   are sorted once more: all but the first of an equal name are repeats.
4. Each document's repeats are cut out of its bytes.

Spark shuffles packed blocks of (name, document, position) by name and sorts
within tasks; a block has been rid of its own repeats before it moves, so a
passage in a third of all documents moves once a block, not once a document.
Long documents are cut into overlapping segments, so memory is bounded.

Defined results: null or empty texts have no bytes and no removals; texts of
fewer than 100 bytes stay whole; a null ``doc_id`` counts after all others;
rows that repeat an id are documents of their own, in the order they are read;
an empty table gives no rows; other columns than ``doc_id`` and ``text`` are
not read, so names cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import n_tasks, schema, utf8, written

LENGTH, GRAM, HALF = 100, 20, 60
WINDOW = LENGTH - GRAM + 1
#: Bytes that are worked on at once.
SEGMENT = 1 << 20
LAST = 2**63 - 1

#: Blocks of names on their way to the task that sorts them, or of marks, which any task hands on.
BLOCKS = schema(to="int", kind="int", n="int", names="binary", places="binary")
NAMES, REPEAT, OPEN = 0, 1, 2
#: Marks (row, first start, last start less the first) on their way to the task that joins a document's own.
MARKS = schema(home="int", kind="int", places="binary")
SPANS = schema(row="long", spans="binary")
COLUMNS = {"doc_id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}


class Names:
    """Fingerprints of substrings: sums of random byte values times powers of an odd number, modulo 2^64."""

    def __init__(self):
        numbers = np.random.default_rng(7)
        self.values = numbers.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = 0x9E3779B97F4A7C15
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 2**64))])

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def segments(lengths: list[int]) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (document, first start, bytes) of about ``SEGMENT`` bytes; long documents are cut."""
    group, size = [], 0
    for d, n in enumerate(lengths):
        for first in range(0, max(n - LENGTH + 1, 0), SEGMENT):
            part = min(n - first, SEGMENT + LENGTH - 1)
            if size and size + part > SEGMENT:
                yield group
                group, size = [], 0
            group.append((d, first, part))
            size += part
    if group:
        yield group


def anchors(names: Names, texts: list[bytes]) -> dict[str, np.ndarray]:
    """Anchors of the texts: document, first and last start, offset of the anchor, and their names."""
    found = {k: [] for k in ("doc", "low", "high", "at", "gram", "whole", "right", "left")}
    for group in segments([len(t) for t in texts]):
        data = np.frombuffer(b"".join(texts[d][a : a + n] for d, a, n in group), np.uint8)
        begins = np.cumsum([0, *(n for _, _, n in group)])
        sums = names.sums(data)
        m = len(data) - GRAM + 1
        best = mixed((sums[GRAM:] - sums[:m]) * names.down[:m]) & ~np.uint64(127)
        width = 1
        while width < WINDOW:  # the least hash of each window, its offset in the low bits: ties go left
            step = min(width, WINDOW - width)
            best = np.minimum(best[:-step], best[step:] + np.uint64(step))
            width += step
        starts = np.concatenate([np.arange(b, b + n - LENGTH + 1) for b, (_, _, n) in zip(begins, group, strict=False)])
        at = starts + (best[starts] & np.uint64(127)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
        low, high, at = starts[cut], starts[np.r_[cut[1:], len(starts)] - 1], at[cut]
        part = np.searchsorted(begins, low, side="right") - 1
        begin, end = begins[part], begins[part + 1]
        whole = names.of(sums, low, high + LENGTH) ^ mixed((at - low).astype(np.uint64) * np.uint64(256) + (high - at + 128).astype(np.uint64))
        right = names.of(sums, at, np.minimum(at + HALF, end))
        left = names.of(sums, np.maximum(at + GRAM - HALF, begin), at + GRAM)
        base = np.array([a for _, a, _ in group])[part] - begin
        doc = np.array([d for d, _, _ in group])[part]
        values = (doc, low + base, high + base, at - low, names.of(sums, at, at + GRAM), whole, right, left)
        for k, v in zip(found, values, strict=True):
            found[k].append(v)
    kinds = {"doc": np.int64, "low": np.int64, "high": np.int64, "at": np.int64}
    return {k: np.concatenate(v) if v else np.zeros(0, kinds.get(k, np.uint64)) for k, v in found.items()}


def deltas(values: np.ndarray) -> bytes:
    return zlib.compress(np.diff(values.astype("<i8"), prepend=0).tobytes(), 1)


def undeltas(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i8"))


def packed(columns: list[np.ndarray]) -> bytes:
    parts = [deltas(c) for c in columns]
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def unpacked(data: bytes, n: int) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data[: 4 * n], "<u4"), 4 * n, []
    for size in sizes.tolist():
        out.append(undeltas(data[at : at + size]))
        at += size
    return out


def stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each stretch of equal values."""
    cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])[: len(values)].tolist()
    return list(zip(cuts, [*cuts[1:], len(values)], strict=False))


def joined(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of starts in order, neighbours of a document joined."""
    order = np.lexsort((low, rows))
    rows, low, high = rows[order], low[order], high[order]
    if not len(rows):
        return rows, low, high
    # a document's marks never nest: each start is marked once by each of its sources
    begin = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (low[1:] > high[:-1] + 1)])
    return rows[begin], low[begin], np.maximum.reduceat(high, begin)


def marks(kind: int, tasks: int, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple]:
    """Marks of many documents as a block for each task that will join them."""
    rows, low, high = joined(rows, low, high)
    home = rows % tasks
    order = np.argsort(home, kind="stable")
    parts = [order[a:b] for a, b in stretches(home[order])]
    return [(int(home[p[0]]), kind, packed([rows[p], low[p], (high - low)[p]])) for p in parts]


def by_document(found: DataFrame, tasks: int) -> DataFrame:
    """One row per document with marks: its spans of first and last starts."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [unpacked(p, 3) for batch in batches for p in batch.places]
        if not parts:
            return
        row, low, width = (np.concatenate(p) for p in zip(*parts, strict=True))
        row, low, high = joined(row, low, low + width)
        spans = np.stack([low, high], axis=1).astype("<u4")
        out = [(int(row[a]), spans[a:b].tobytes()) for a, b in stretches(row)]
        yield pd.DataFrame(out, columns=SPANS.names)

    return found.select("home", "places").repartition(tasks, "home").mapInPandas(rows, SPANS)


def firsts(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``keys`` and then ``order``, and where in it a new key begins."""
    at = np.lexsort((*order[::-1], *keys[::-1]))
    new = np.zeros(len(at), bool)
    new[:1] = True
    for k in keys:
        k = k[at]
        new[1:] |= k[1:] != k[:-1]
    return at, new


def dealt(to: np.ndarray, names: list[np.ndarray], places: list[np.ndarray]) -> Iterator[tuple]:
    """Blocks of what goes to each task."""
    order = np.argsort(to, kind="stable")
    for a, b in stretches(to[order]):
        own = order[a:b]
        blob = b"".join(x[own].tobytes() for x in names)
        yield int(to[own[0]]), NAMES, b - a, blob, packed([x[own] for x in places])


def stored(docs: DataFrame) -> DataFrame:
    """Documents with a row number and their bytes compressed, written once: they are read three times."""

    @F.pandas_udf(T.BinaryType())
    def squeezed(texts: pd.Series) -> pd.Series:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        return pd.Series([pack.compress(utf8(t)) for t in texts], dtype=object)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), squeezed("text").alias("data"))
    return written(rows.withColumn("order", F.coalesce("doc_id", F.lit(LAST))))


def bytes_of(data) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(d) for d in data]


def gather(batches: Iterator[pd.DataFrame], kinds: list[str], places: int):
    """All blocks of a task as arrays of names and places, and the marks that came along."""
    names, where, done = [], [], []
    for batch in batches:
        for to, kind, n, blob, rest in batch.itertuples(index=False):
            if kind != NAMES:
                done.append((to, kind, rest))
                continue
            at = 0
            own = []
            for kind in kinds:
                size = np.dtype(kind).itemsize * n
                own.append(np.frombuffer(blob[at : at + size], kind))
                at += size
            names.append(own)
            where.append(unpacked(rest, places))
    join = lambda parts: [np.concatenate(p) for p in zip(*parts, strict=True)]
    return join(names), join(where), done


def own_marks(found: list[tuple]) -> list[tuple]:
    """Marks as blocks, to pass through the shuffle of names."""
    return [(home, kind, 0, b"", places) for home, kind, places in found]


def anchor_marks(rows: DataFrame, tasks: int) -> DataFrame:
    """Marks of repeated anchors, and open spans whose positions must be named by all their bytes."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names()
        for batch in batches:
            a = anchors(names, bytes_of(batch.data))
            row, order = batch.row.to_numpy()[a["doc"]], batch.order.to_numpy()[a["doc"]]
            at, new = firsts([a["gram"], a["whole"]], [order, row, a["low"]])
            again = at[~new]
            out = own_marks(marks(REPEAT, tasks, row[again], a["low"][again], a["high"][again]))
            keep = np.sort(at[new])
            cut = lambda x: (x[keep] >> np.uint64(32)).astype("<u4")
            sent = [a["whole"][keep].astype("<u8"), cut(a["gram"]), cut(a["right"]), cut(a["left"])]
            to = (a["gram"][keep] % np.uint64(2 * tasks)).astype(np.int64)
            low = a["low"][keep]
            out += dealt(to, sent, [order[keep], row[keep], low, a["high"][keep] - low, a["at"][keep]])
            yield pd.DataFrame(out, columns=BLOCKS.names)

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got, places, done = gather(batches, ["<u8", "<u4", "<u4", "<u4"], 5)
        yield pd.DataFrame(done, columns=MARKS.names)
        if not got:
            return
        whole, gram, right, left = got
        order, row, low, width, at = places
        by, new = firsts([gram, whole], [order, row, low])
        again, one = by[~new], by[new]
        yield pd.DataFrame(marks(REPEAT, tasks, row[again], low[again], (low + width)[again]), columns=MARKS.names)

        def common(name: np.ndarray) -> np.ndarray:
            """Which of the firsts share ``gram`` and ``name`` with another."""
            by, new = firsts([gram[one], name[one]], [])
            group = np.cumsum(new) - 1
            out = np.zeros(len(one), bool)
            out[by] = np.bincount(group, minlength=1)[group] > 1
            return out

        # starts up to 40 before the anchor hold the 60 bytes from it on, the others those before
        first, last, anchor = low[one], (low + width)[one], (low + at)[one]
        split = anchor - (HALF - GRAM)
        low = np.where(common(right), np.maximum(first, split), last + 1)
        wide = common(left)
        low = np.where(wide, first, low)
        high = np.where(common(right), last, np.where(wide, np.minimum(last, split), -1))
        use = low <= high
        yield pd.DataFrame(marks(OPEN, tasks, row[one][use], low[use], high[use]), columns=MARKS.names)

    sent = rows.select("row", "order", "data").mapInPandas(blocks, BLOCKS)
    return written(sent.repartition(tasks, "to").mapInPandas(ranked, MARKS))


def position_marks(opened: DataFrame, tasks: int) -> DataFrame:
    """Marks of positions in open spans (row, order, data, spans) whose 100 bytes start earlier too."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names()
        half = np.uint64(names.base)
        for batch in batches:
            found = [[], [], [], []]
            for row, order, data, spans in zip(batch.row, batch.order, bytes_of(batch.data), batch.spans, strict=True):
                pairs = np.frombuffer(spans, "<u4").reshape(-1, 2).astype(np.int64)
                for first in range(0, len(data) - LENGTH + 1, SEGMENT):
                    last = min(first + SEGMENT, len(data) - LENGTH + 1) - 1
                    own = pairs[(pairs[:, 0] <= last) & (pairs[:, 1] >= first)].clip(first, last) - first
                    if not len(own):
                        continue
                    p = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in own]))
                    sums = names.sums(np.frombuffer(data, np.uint8, last - first + LENGTH, first))
                    mid = p + LENGTH // 2
                    name = mixed(names.of(sums, p, mid) * half + names.of(sums, mid, p + LENGTH))
                    for k, v in enumerate((name, np.full(len(p), order), np.full(len(p), row), p + first)):
                        found[k].append(v)
            if not found[0]:
                continue
            name, order, row, p = map(np.concatenate, found)
            at, new = firsts([name], [order, row, p])
            again, keep = at[~new], np.sort(at[new])
            out = own_marks(marks(REPEAT, tasks, row[again], p[again], p[again]))
            to = (name[keep] % np.uint64(2 * tasks)).astype(np.int64)
            out += dealt(to, [name[keep].astype("<u8")], [order[keep], row[keep], p[keep]])
            yield pd.DataFrame(out, columns=BLOCKS.names)

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got, places, done = gather(batches, ["<u8"], 3)
        yield pd.DataFrame(done, columns=MARKS.names)
        if got:
            order, row, p = places
            at, new = firsts([got[0]], [order, row, p])
            again = at[~new]
            yield pd.DataFrame(marks(REPEAT, tasks, row[again], p[again], p[again]), columns=MARKS.names)

    sent = opened.mapInPandas(blocks, BLOCKS)
    return written(sent.repartition(tasks, "to").mapInPandas(ranked, MARKS))


def cut_out(data: bytes, spans: bytes | None) -> tuple[int, int, bytes]:
    """Bytes removed, runs of them, and the bytes that stay; spans hold first and last starts, in order."""
    if not spans:
        return 0, 0, data
    pairs = np.frombuffer(spans, "<u4").reshape(-1, 2).astype(np.int64)
    low, high = pairs[:, 0], np.maximum.accumulate(pairs[:, 1] + LENGTH)
    new = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
    low, high = low[new], high[np.r_[new[1:], len(high)] - 1]
    kept = [data[a:b] for a, b in zip(np.r_[0, high], np.r_[low, len(data)], strict=True)]
    return int((high - low).sum()), len(low), b"".join(kept)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: sizes, runs and digest of what stays, and the bytes ``with_text``."""
    tasks = n_tasks(docs.sparkSession)
    rows = stored(docs)
    found = anchor_marks(rows, tasks)
    opened = by_document(found.filter(F.col("kind") == OPEN), tasks).join(rows, "row")
    more = position_marks(opened.select("row", "order", "data", "spans"), tasks)
    repeats = by_document(found.filter(F.col("kind") == REPEAT).union(more), tasks)

    def results(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, data, spans in zip(batch.order, bytes_of(batch.data), batch.spans, strict=True):
                removed, n, kept = cut_out(data, spans)
                row = (None if doc_id == LAST else doc_id, len(data), removed, n, hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if with_text else row)
            yield pd.DataFrame(out, columns=result.names).astype({"doc_id": "Int64"})

    result = schema(**COLUMNS, **({"kept": "binary"} if with_text else {}))
    return rows.join(repeats, "row", "left").select("order", "data", "spans").mapInPandas(results, result)
