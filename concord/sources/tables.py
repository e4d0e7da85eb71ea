"""CSV and Parquet tables, and small literal relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header. Give the schema for large data: inferring it reads the data once more."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def literal_rows(spark: SparkSession, rows: Sequence[tuple] | Mapping, schema: str) -> DataFrame:
    """A small relation from tuples, or from a mapping of key to value."""
    return spark.createDataFrame(list(rows.items()) if isinstance(rows, Mapping) else list(rows), schema)
