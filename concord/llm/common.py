"""Helpers shared by the operators of this package: tables, the shared folder, words, tokenizers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` cuts at exactly the six ASCII space characters."""
    return utf8(text).split()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors all reach, under ``spark.checkpoint.dir``.

    Where the setting is missing (tests in one process) a temporary folder is
    set; on a cluster that would be lost with its machine, so it is refused.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
        top = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(top)
        top = spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts the lineage for good."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def n_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def open_store(path: str):
    """File system and place of a path, for reading and writing files inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def give_back() -> None:
    """What this process has freed goes back to the system: Python workers outlive their tasks, and keep it otherwise."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the C library of Linux
        trim(0)


def giving_back(work: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``work`` on the batches of a task, whose memory is given back when it ends."""

    def rows(batches: Iterable) -> Iterator:
        yield from work(batches)
        give_back()

    return rows


TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}
TYPES |= {"boolean": T.BooleanType(), "binary": T.BinaryType()}


def schema(**columns: str) -> T.StructType:
    """A schema that needs no running session, unlike a DDL string."""
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in columns.items()])


def keyed(*others: str) -> list:
    """``doc_id`` without nulls, ``no_id`` where it was null, and other columns: pandas keeps long ids exact."""
    return [F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), *others]


def ids_of(batch) -> list[int | None]:
    return [None if none else i for i, none in zip(batch.doc_id.tolist(), batch.no_id.tolist(), strict=True)]
