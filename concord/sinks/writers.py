"""Table and text sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.operators.votes import ITEM, MODEL


def write_parquet(df: DataFrame, path: str) -> DataFrame:
    """Overwrite, then read back what was written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_runs(df: DataFrame, path: str) -> None:
    """Add the rows of a run; every part file has its own header."""
    df.write.mode("append").option("header", True).csv(path)


def stored_predictions(spark: SparkSession, path: str) -> DataFrame:
    """All stored predictions; model names are text whatever they look like."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(MODEL, T.StringType()) if f.name == MODEL else f for f in found.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def _files(spark: SparkSession, path: str, model: str) -> set[str]:
    """The files that hold the predictions of one model."""
    try:
        stored = stored_predictions(spark, path)
    except AnalysisException:  # nothing stored yet
        return set()
    return {r[0] for r in stored.filter(F.col(MODEL) == model).select("_metadata.file_path").distinct().collect()}


def upsert_predictions(results: DataFrame, model: str, path: str) -> None:
    """Replace the stored predictions of one model; the other models' files stay untouched.

    New files are complete before old ones go: a write that fails leaves the old
    predictions as they were. A result without rows leaves the model without
    predictions instead of with stale ones.
    """
    spark = results.sparkSession
    before = _files(spark, path, model)
    rows = results.drop(MODEL).withColumn(MODEL, F.lit(model))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MODEL).parquet(path)
    if before and _files(spark, path, model) == before:  # no row, so no folder was replaced
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(min(before))).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_predictions(spark: SparkSession, path: str, listing: DataFrame) -> DataFrame:
    """Stored predictions aligned to the record listing; a record without any keeps one null row."""
    return listing.join(stored_predictions(spark, path), ITEM, "left")


def write_tables(tables: Mapping[str, DataFrame], root: str) -> None:
    """One folder per table below ``root``."""
    for name, df in tables.items():
        write_csv(df, f"{root.rstrip('/')}/{name}")


def write_lines(lines: DataFrame, path: str) -> None:
    """A single text column as lines."""
    lines.write.mode("overwrite").text(path)
