"""Agreement of voters by bit matrices.

Votes become bit rows: for each label the items that a voter gave it to, one bit
an item. The items on which two voters agree are the bits that their rows
share, counted word by word, so a pair costs a machine word for 64 items
whatever the number of voters, and a label only looks at the items that have it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of bit rows that are compared at once.
AT_ONCE = 16 << 20
#: Items that a block holds at most.
BLOCK = 1 << 14


def shared_bits(rows: np.ndarray) -> np.ndarray:
    """How many set places each pair of rows of a boolean matrix shares."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 64) * 8), dtype=np.uint8)
    packed = np.packbits(rows, axis=1)
    words[:, : packed.shape[1]] = packed
    words = words.view(np.uint64)
    out = np.empty((n, n), dtype=np.int64)
    step = max(1, AT_ONCE // max(1, words.nbytes))
    for low in range(0, n, step):
        both = words[low : low + step, None, :] & words[None, :, :]
        out[low : low + step] = np.bitwise_count(both).sum(axis=2, dtype=np.int64)
    return out


def agreements(voter: np.ndarray, item: np.ndarray, label: np.ndarray, n_voters: int, n_items: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of voters the items both voted on and those with equal labels; a vote each a voter and item."""
    voted = np.zeros((n_voters, n_items), dtype=bool)
    voted[voter, item] = True
    both, same = shared_bits(voted), np.zeros((n_voters, n_voters), dtype=np.int64)
    order = np.argsort(label, kind="stable")
    voter, item, label = voter[order], item[order], label[order]
    cuts = np.flatnonzero(label[1:] != label[:-1]) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(label)], strict=True):
        if high == low:
            continue
        who, row = np.unique(voter[low:high], return_inverse=True)
        what, column = np.unique(item[low:high], return_inverse=True)
        rows = np.zeros((len(who), len(what)), dtype=bool)
        rows[row, column] = True
        same[np.ix_(who, who)] += shared_bits(rows)
    return both, same


def _codes(column: pa.Array) -> np.ndarray:
    """A number for each value; -1 for null."""
    found = pc.dictionary_encode(column)
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    return pc.fill_null(found.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


PAIR = T.StructType([T.StructField(c, T.LongType()) for c in ("i", "j", "n_both", "n_same")])


def _rows(both: np.ndarray, same: np.ndarray) -> dict:
    i, j = np.triu_indices(len(both))
    return {"i": i, "j": j, "n_both": both[i, j], "n_same": same[i, j]}


def pairs_of_wide(wide: DataFrame, voters: Sequence[str]) -> DataFrame:
    """``i, j, n_both, n_same`` for each pair ``i <= j`` of places in ``voters``; one column of ``wide`` a voter."""
    n = len(voters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = same = np.zeros((n, n), dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                label = _codes(pa.chunked_array(part.columns))
                voter, item = np.divmod(np.arange(len(label)), part.num_rows)
                given = label >= 0
                a, b = agreements(voter[given], item[given], label[given], n, part.num_rows)
                both, same = both + a, same + b
        yield pa.RecordBatch.from_pydict(_rows(both, same))

    counted = wide.select(*[F.col(f"`{v}`").cast("string").alias(f"v{i}") for i, v in enumerate(voters)]).mapInArrow(count, PAIR)
    every = wide.sparkSession.range(n * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"))
    zeros = every.filter("i <= j").select("i", "j", F.lit(0).cast("long").alias("n_both"), F.lit(0).cast("long").alias("n_same"))
    return counted.union(zeros).groupBy("i", "j").agg(F.sum("n_both").alias("n_both"), F.sum("n_same").alias("n_same"))


def pairs_of_long(votes: DataFrame, item: str, model: str, label: str) -> DataFrame:
    """``model_a, model_b, n_both, n_same`` for each pair ``model_a <= model_b`` with a common item.

    Voters need not be known: a task numbers those it meets. Votes are
    shuffled by item, and a task takes its items in blocks.
    """
    names = T.StructType([T.StructField(c, T.StringType()) for c in ("model_a", "model_b")] + PAIR.fields[2:])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        sums: dict[tuple[str, str], np.ndarray] = {}

        def take(rows: pa.Table) -> None:
            items, who = _codes(rows["item"]), pc.dictionary_encode(rows["model"].combine_chunks())
            listed = who.dictionary.to_pylist()
            both, same = agreements(
                who.indices.to_numpy(zero_copy_only=False).astype(np.int64), items, _codes(rows["label"]), len(listed), int(items.max()) + 1
            )
            for i, j in zip(*np.nonzero(both), strict=True):
                if listed[i] <= listed[j]:
                    pair = sums.setdefault((listed[i], listed[j]), np.zeros(2, dtype=np.int64))
                    pair += (both[i, j], same[i, j])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < BLOCK:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            codes = _codes(rows["item"])
            last = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if (codes != codes[-1]).any() else 0
            if last:  # the last item may go on in the next batch
                take(rows.slice(0, last))
            held = rows.slice(last).to_batches()
        if held:
            take(pa.Table.from_batches(held))
        given = list(sums.items())
        columns = [[a for (a, _), _ in given], [b for (_, b), _ in given], [int(n[0]) for _, n in given], [int(n[1]) for _, n in given]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names.names)

    rows = votes.dropna(subset=[model, label]).select(F.col(item).alias("item"), F.col(model).alias("model"), F.col(label).cast("string").alias("label"))
    counted = rows.repartition("item").sortWithinPartitions("item").mapInArrow(count, names)
    return counted.groupBy("model_a", "model_b").agg(F.sum("n_both").alias("n_both"), F.sum("n_same").alias("n_same"))
