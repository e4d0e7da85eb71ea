"""Files as records and folders as classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.functions import paths
from concord.operators.small import attach


def read_files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """``path, modificationTime, length, content``; content is only read where it is selected."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
    )


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """The record listing alone: ``path``, no file content read."""
    return read_files(spark, root, glob).select("path")


def list_sizes(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """The record listing with file sizes: ``path, length``, no file content read."""
    return read_files(spark, root, glob).select("path", "length")


#: Groups whose sums are put in order when records are placed by size.
GROUPS = 1024


def placed_by_size(listing: DataFrame, tasks: int, key: str = "path", size: str = "length") -> DataFrame:
    """``listing`` dealt over ``tasks`` partitions of about equal bytes, for scorers that read files of any length.

    Each record's place is the sum of the sizes before it, taken first over
    hash groups of records, of which there are ``GROUPS``, and then inside its
    group; equal stretches of that line are the tasks, and a record belongs where its
    middle lies. So a file larger than a task's share has a task nearly for
    itself. Only keys and sizes are looked at.
    """
    weight = F.coalesce(F.col(size), F.lit(0)).cast("double") + 1  # empty files are work as well
    rows = listing.withColumn("_weight", weight).withColumn("_group", F.pmod(F.xxhash64(key), F.lit(GROUPS)))
    sums = rows.groupBy("_group").agg(F.sum("_weight").alias("_sum"))
    # One row per group from here on.
    along = Window.orderBy("_group")
    sums = sums.select(
        "_group", (F.sum("_sum").over(along) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("_total")
    )
    inside = Window.partitionBy("_group").orderBy(key, size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("_before") + F.sum("_weight").over(inside) - F.col("_weight") / 2
    task = F.least(F.lit(tasks - 1), F.floor(middle * tasks / F.col("_total"))).cast("int")
    placed = rows.join(sums, "_group").withColumn("_task", task)
    return placed.repartitionById(tasks, F.col("_task")).select(*listing.columns)


def with_extension(df: DataFrame, path: str, extensions: Sequence[str], case_sensitive: bool = False) -> DataFrame:
    """Rows whose file extension is allowed, with the extension as ``ext``."""
    found = paths.extension(F.col(path))
    ext = found if case_sensitive else F.lower(found)
    return df.withColumn("ext", ext).filter(F.col("ext").isin(*extensions))


def with_folder_label(df: DataFrame, path: Column, root: str = "") -> DataFrame:
    """Adds ``label``, the first folder under ``root``, and ``class_index``, its sorted position.

    Only the distinct labels are put in order. Files outside a class folder
    are no part of the dataset and drop out.
    """
    labelled = df.withColumn("label", paths.first_folder(path, root)).dropna(subset=["label"])
    classes = labelled.select("label").distinct()
    # One row per class from here on.
    position = F.row_number().over(Window.orderBy("label")) - 1
    return attach(labelled, classes.withColumn("class_index", position.cast("bigint")), ["label"])


def with_ground_truth(df: DataFrame, path: str = "filepath") -> DataFrame:
    """Adds ``ground_truth``: an existing truth or label column, else the parent folder of the path."""
    if "ground_truth" in df.columns:
        return df
    if "label" in df.columns:
        return df.withColumn("ground_truth", F.col("label"))
    return df.withColumn("ground_truth", paths.parent_folder(F.col(path)))
