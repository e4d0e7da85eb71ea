"""Packing: documents to token windows by the sum-of-squares rule, one packer a task, no shuffle.

A document longer than a window fills whole windows first. What is left goes
to the fill level that makes the sum of squared counts of partly filled
windows smallest; the counts stand in an array by level, and the windows of a
level on a stack. Ties go to the fullest level. When a task ends, or holds
``MAX_OPEN`` windows, documents in the emptiest windows are cut to fill the
fullest; at the end of a task the one window that is left is cut at powers of
two, so no token is padding.

Defined results: a null or empty text is a document of the end id alone; every
row is a document of its own, also where ids repeat or are null; an empty
table gives no rows; only ``doc_id`` and ``text`` are read, so names cannot
clash. Windows are numbered by task, so a task that runs again gives the same
rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from concord.llm.common import giving_back, keyed, schema
from concord.llm.tokens import Encoder

WINDOW = 2048
#: Open windows a task holds at most: 32 MB of ids.
MAX_OPEN = 4096
#: Rows a task gives away at once.
MOST_ROWS = 4096

RESULT = schema(
    doc_id="long",
    start="long",
    length="long",
    ids_crc32="long",
    doc_tokens="long",
    sequence_id="long",
    offset="long",
)


class Packer:
    """Places documents one after another; ``done`` collects the pieces of closed windows.

    A piece is (doc_id, start in the document, ids, tokens of the document); an
    open window is a list of pieces.
    """

    def __init__(self, first_id: int = 0, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open, self.next_id = window, max_open, first_id
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.levels: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open, self.done = 0, []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self.close([(doc_id, start, ids[start : start + self.window], total)])
            start += self.window
        if start < total:
            self.place((doc_id, start, ids[start:], total))

    def place(self, piece) -> None:
        size, counts = len(piece[2]), self.counts
        # change of the sum of squares, halved, by level before placing
        change = counts[size:] - counts[: self.window + 1 - size] + 1.0
        change[counts[: len(change)] == 0] = np.inf
        change[0] = counts[size] + 0.5
        if counts[self.window - size]:
            change[-1] = 0.5 - counts[self.window - size]
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        if level:
            opened = self.levels[level].pop()
            counts[level] -= 1
            self.n_open -= 1
        else:
            opened = []
        opened.append(piece)
        if level + size == self.window:
            self.close(opened)
            return
        self.levels[level + size].append(opened)
        counts[level + size] += 1
        self.n_open += 1
        if self.n_open >= self.max_open:
            self.merge()

    def merge(self) -> None:
        """Fill the fullest windows with cut-off ends of the emptiest; at most one stays open."""
        opened = [(fill, w) for fill in range(self.window, 0, -1) for w in self.levels[fill]]
        self.levels = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        low, high = 0, len(opened) - 1
        while low < high:
            fill, target = opened[low]
            size, source = opened[high]
            doc_id, start, ids, total = source[-1]
            moved = min(len(ids), self.window - fill)
            kept = len(ids) - moved
            target.append((doc_id, start + kept, ids[kept:], total))
            if kept:
                source[-1] = (doc_id, start, ids[:kept], total)
            else:
                source.pop()
            opened[low], opened[high] = (fill + moved, target), (size - moved, source)
            if not source:
                high -= 1
            if fill + moved == self.window:
                self.close(target)
                low += 1
        self.n_open = 0
        if low == high:
            fill, last = opened[low]
            self.levels[fill].append(last)
            self.counts[fill] = self.n_open = 1

    def finish(self) -> None:
        self.merge()
        for level in self.levels:
            for opened in level:
                self.cut(opened)

    def cut(self, pieces) -> None:
        """Close the pieces as windows whose lengths are powers of two."""
        left = sum(len(p[2]) for p in pieces)
        pieces = pieces[::-1]
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            part = []
            while size:
                doc_id, start, ids, total = pieces.pop()
                part.append((doc_id, start, ids[:size], total))
                if len(ids) > size:
                    pieces.append((doc_id, start + size, ids[size:], total))
                size -= len(part[-1][2])
            self.close(part)

    def close(self, pieces) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids), total, self.next_id, offset, ids))
            offset += len(ids)
        self.next_id += 1

    def rows(self, with_ids: bool) -> pd.DataFrame:
        done, self.done = self.done, []
        names = [*RESULT.names, "ids"]
        out = pd.DataFrame(done, columns=names).astype({"doc_id": "Int64"})
        return out if with_ids else out[RESULT.names]


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the token ids themselves."""

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, packer = Encoder(vocabulary), Packer(TaskContext.get().partitionId() << 40)
        for doc_id, ids in encode.batches(batches):
            packer.add(doc_id, ids)
            if len(packer.done) >= MOST_ROWS:
                yield packer.rows(with_ids)
        packer.finish()
        yield packer.rows(with_ids)

    result = T.StructType([*RESULT.fields, T.StructField("ids", T.ArrayType(T.LongType()))]) if with_ids else RESULT
    return docs.select(*keyed("text")).mapInPandas(giving_back(tasks), result)
