"""Corpus pipeline: documents to packed token windows.

Five stages, each over all that its predecessor kept and each written as
Parquet and read back for the next: quality rules (rejected documents go),
near-duplicates (one document of each group stays), secret scan (secrets are
blacked out), mixing (documents are repeated or cut as the mix takes them),
packing. All but the last return the columns of ``documents``; other columns
pass through, whatever their names. Near-duplicates are told apart by numbers
that are written once with the documents, not by their place in a scan.

Empty inputs give empty outputs; null texts fail the quality rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm import line_crf, minhash, mixing, packing, secrets
from concord.llm.common import WORD, table, text_or_empty, written

#: Documents of an Arrow batch, for all stages from the first on.
ROWS = 1000


def bounded(spark: SparkSession) -> None:
    """Texts go to Python in batches of at most ``ROWS`` documents: they may be long, and workers keep what they once took."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are mostly content."""
    bounded(spark)
    model = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    judged = docs.select(F.struct("*").alias("d"), line_crf.verdict(F.col("text"), model).alias("v"))
    return judged.filter("v.kept").select("d.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    bounded(spark)
    numbered = written(docs.select(F.struct("*").alias("d"), F.monotonically_increasing_id().alias("row")))
    stays = minhash.link_documents(numbered.select("d.doc_id", "d.text", "row"), F.col("row")).filter("stays").select("row")
    return numbered.join(stays, "row", "left_semi").select("d.*")


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with another text and its length, all other columns as they are."""
    new = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("d"), text.alias("t"))
    columns = {c: F.col(f"d.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("t")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("t").cast(docs.schema["n_chars"].dataType)
    return new.select(*[columns[c].alias(c) for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in their texts replaced by a mark."""
    bounded(spark)
    return with_text(docs, secrets.redact("text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; where it takes a part, the first words of it."""
    taken = mixing.mix(docs).filter("taken > 0").select(
        F.struct("doc_id", "source", "size").alias("key"), "copy", "taken"
    )
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    rows = docs.select(
        F.struct("*").alias("d"), F.struct("doc_id", "source", size.alias("size")).alias("k"), F.xxhash64("text").alias("at")
    )
    same = F.row_number().over(Window.partitionBy("k").orderBy("at")) - 1
    rows = rows.withColumn("n", same)
    found = rows.join(taken, F.col("k").eqNullSafe(F.col("key")) & (F.col("n") == F.col("copy")))
    whole, rest = F.floor(F.col("taken") / F.col("k.size")), F.col("taken") % F.col("k.size")
    times = F.explode(F.sequence(F.lit(1), whole + F.when(rest > 0, 1).otherwise(0)))
    found = found.select("d", rest.alias("rest"), whole.alias("whole"), times.alias("time"))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("d.text"), F.lit(WORD), F.lit(0)), 1, F.col("rest").cast("int")), " ")
    text = F.when(F.col("time") > F.col("whole"), part).otherwise(F.col("d.text"))
    columns = {c: F.col(f"d.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token windows."""
    bounded(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None  # line labels, signatures and tokens are beyond SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
