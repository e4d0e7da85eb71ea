"""Token files: ids at the fewest bits the vocabulary needs, in blocks that can be read on their own.

Documents are ordered by id over range partitions, one file a task. A file is

    magic | packed blocks | index | trailer

Each block holds ``BLOCK`` ids (the last one fewer) at fixed width, little end
first, padded to a byte. The index holds the byte offset of each block and
for each document its id, first position and length; the trailer says where
the index starts. Any range of ids is read by fetching its blocks alone.

Files are named anew by each attempt of a task and count only if they are in
the manifest, so a task that runs again leaves no half-written file behind it.

Defined results: null or empty texts hold the end id alone; a null ``doc_id``
sorts first and reads back as null; rows that repeat an id are ordered by the
hash of their text, equal ones in any order; an empty table gives an empty
manifest and no rows; other columns are not read, so names cannot clash.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import keyed, n_tasks, open_store, schema, shared_folder, written
from concord.llm.tokens import Encoder

MAGIC = b"TKF1"
BLOCK = 1 << 16
TRAILER = "<QQQQIB4s"  # index offset, blocks, documents, ids, ids a block, bits, magic

MANIFEST = schema(part="int", path="string", n_docs="long", n_ids="long")
RESULT = schema(doc_id="long", start="long", n_tokens="long", ids_crc32="long")


#: Widths at which ids are whole machine words.
WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def places(bits: int) -> Iterator[tuple[int, int, int, int]]:
    """Eight ids fill ``bits`` bytes: for each id and byte it reaches, id, byte, shift of the id and shift to the byte."""
    for i in range(8):
        first, shift = divmod(i * bits, 8)
        for n in range((bits + shift + 7) // 8):
            yield i, first + n, shift, 8 * n


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at fixed width, little end first, by shifts of whole columns of eight ids."""
    if bits in WHOLE:
        return ids.astype(WHOLE[bits]).tobytes()
    size = (len(ids) * bits + 7) // 8
    padded = np.zeros(-(-len(ids) // 8) * 8, dtype=np.uint64)
    padded[: len(ids)] = ids
    groups = padded.reshape(-1, 8)
    out = np.zeros((len(groups), bits), dtype=np.uint8)
    for i, byte, shift, down in places(bits):
        out[:, byte] |= ((groups[:, i] << np.uint64(shift)) >> np.uint64(down)).astype(np.uint8)
    return out.tobytes()[:size]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in WHOLE:
        return np.frombuffer(data, WHOLE[bits], count=n).astype("<u4")
    whole = -(-n // 8)
    filled = np.zeros(whole * bits, dtype=np.uint8)
    filled[: len(data)] = np.frombuffer(data, np.uint8)[: whole * bits]
    given = filled.reshape(whole, bits).astype(np.uint64)
    out = np.zeros((whole, 8), dtype=np.uint64)
    for i, byte, shift, down in places(bits):
        out[:, i] |= (given[:, byte] << np.uint64(down)) >> np.uint64(shift)
    return (out.ravel()[:n] & np.uint64((1 << bits) - 1)).astype("<u4")


class Writer:
    """Appends documents to one token file."""

    def __init__(self, path: str, vocabulary: int):
        system, place = open_store(path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(place)
        self.out.write(MAGIC)
        self.at, self.bits = len(MAGIC), max(1, (vocabulary - 1).bit_length())
        self.waiting, self.n_waiting, self.n_ids = [], 0, 0
        self.blocks, self.docs = [], []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, self.n_ids, len(ids)))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self.block(ids[i : i + BLOCK])
            self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.blocks.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.n_waiting:
            self.block(np.concatenate(self.waiting))
        names, empty, starts, lengths = zip(*self.docs, strict=True) if self.docs else ((), (), (), ())
        self.out.write(np.array([*self.blocks, self.at], "<u8").tobytes())
        self.out.write(np.array(names, "<i8").tobytes() + np.array(empty, "u1").tobytes())
        self.out.write(np.array(starts, "<u8").tobytes() + np.array(lengths, "<u8").tobytes())
        self.out.write(struct.pack(TRAILER, self.at, len(self.blocks), len(self.docs), self.n_ids, BLOCK, self.bits, MAGIC))
        self.out.close()


class Reader:
    """Random access to one token file; holds its index and one block."""

    def __init__(self, path: str):
        system, place = open_store(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        self.file.seek(size - struct.calcsize(TRAILER))
        index, blocks, docs, self.n_ids, self.per_block, self.bits, magic = struct.unpack(TRAILER, self.file.read())
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.file.seek(index)
        self.blocks = np.frombuffer(self.file.read(8 * (blocks + 1)), "<u8")
        self.doc_ids = np.frombuffer(self.file.read(8 * docs), "<i8")
        self.empty = np.frombuffer(self.file.read(docs), "u1")
        self.starts = np.frombuffer(self.file.read(8 * docs), "<u8")
        self.lengths = np.frombuffer(self.file.read(8 * docs), "<u8")
        self.held = (-1, None)

    def block(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            low, high = int(self.blocks[k]), int(self.blocks[k + 1])
            self.file.seek(low)
            n = min(self.per_block, self.n_ids - k * self.per_block)
            self.held = (k, unpack(self.file.read(high - low), n, self.bits))
        return self.held[1]

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids ``start`` to ``start + n`` of the file, block by block."""
        while n > 0:
            k, at = divmod(start, self.per_block)
            got = self.block(k)[at : at + n]
            yield got
            start, n = start + len(got), n - len(got)


def write(docs: DataFrame, folder: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Encode ``docs`` into token files; returns the manifest: part, path, n_docs, n_ids."""

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, out = Encoder(vocabulary), TaskContext.get().partitionId(), None
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tkf"
        for doc_id, ids in encode.batches(batches):
            out = out or Writer(path, encode.vocabulary())
            out.add(doc_id, ids)
        if out:
            out.close()
            yield pd.DataFrame([(part, path, len(out.docs), out.n_ids)], columns=MANIFEST.names)

    spark = docs.sparkSession
    named = docs.select(
        *keyed("text"),
        F.xxhash64("text").alias("tie"),
        F.monotonically_increasing_id().alias("row"),  # splits an id that fills many partitions
    )
    order = [F.desc("no_id"), F.asc("doc_id"), F.asc("tie"), F.asc("row")]
    named = named.repartitionByRange(n_tasks(spark), *order).sortWithinPartitions(*order)
    return named.select("doc_id", "no_id", "text").mapInPandas(files, MANIFEST)


def read(manifest: DataFrame) -> DataFrame:
    """One row per document in the files: id, ids of all documents before it, length, CRC-32 of its ids."""
    files = manifest.count()  # one row a file: a range partition each
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = manifest.select("path", F.coalesce(before, F.lit(0)).alias("before"))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, first in zip(batch.path, batch.before, strict=True):
                file = Reader(path)
                rows = []
                for doc_id, empty, start, n in zip(file.doc_ids, file.empty, file.starts, file.lengths, strict=True):
                    crc = 0
                    for ids in file.ids(int(start), int(n)):
                        crc = zlib.crc32(ids.tobytes(), crc)
                    rows.append((None if empty else int(doc_id), first + int(start), int(n), crc))
                out = pd.DataFrame(rows, columns=RESULT.names)
                yield out.astype({"doc_id": "Int64"})

    return starts.repartition(max(1, files)).mapInPandas(documents, RESULT)


def round_trip(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Write the token files to a new shared folder and read every document back from them."""
    folder = shared_folder(docs.sparkSession)
    return read(written(write(docs, folder, vocabulary)))
