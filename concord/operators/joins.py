"""Merges of record listings, result tables and fixed name lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.votes import ITEM, LABEL, MODEL, aligned


def merge_onto(listing: DataFrame, results: DataFrame, on: str | list[str] = ITEM) -> DataFrame:
    """Every record of the listing, with its results where there are any."""
    return listing.join(results, on, "left")


def restrict_to(df: DataFrame, allowed: DataFrame, on: str | list[str] = LABEL) -> DataFrame:
    """Rows whose key is among the allowed ones."""
    return df.join(allowed, on, "left_semi")


def priority_fill(preferred: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """All preferred rows, plus the fallback rows whose key they lack."""
    return preferred.unionByName(fallback.join(preferred, keys, "left_anti"), allowMissingColumns=True)


def reindex(df: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    """One row per wanted key with its ``position``; null columns for an unknown key."""
    listed = df.sparkSession.createDataFrame(list(enumerate(wanted)), f"position bigint, {key} string")
    return listed.join(df.filter(F.col(key).isin(*wanted)), key, "left")


def intersect_names(df: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    """The wanted keys that occur in ``df``, with their position in the list."""
    listed = df.sparkSession.createDataFrame(list(enumerate(wanted)), f"position bigint, {key} string")
    return listed.join(df.select(key).filter(F.col(key).isin(*wanted)).distinct(), key, "left_semi")


def task_grid(datasets: DataFrame, models: Sequence[str], available: DataFrame, key: str = "dataset") -> DataFrame:
    """Every available dataset with every model, as one task row each."""
    present = datasets.join(available.select(key).distinct(), key, "left_semi")
    return present.select(key, F.explode(F.array(*[F.lit(m) for m in models])).alias(MODEL))


def upsert_model(
    existing: DataFrame, new: DataFrame, model: str, listing: DataFrame, restricted: bool = False
) -> DataFrame:
    """The long table with one model's rows replaced, for the records now listed.

    No new rows at all still replace the old ones; rows without a model stay.
    Of ``restricted`` tables both hold rows of listed records alone already.
    """
    kept = existing.filter(~F.col(MODEL).eqNullSafe(model))
    fresh = new.withColumn(MODEL, F.lit(model))
    return aligned(kept.unionByName(fresh, allowMissingColumns=True), listing, restricted)


def union_rows(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows of all tables by column name; a missing column is null."""
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def label_universe(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct non-null values over several label columns."""
    labels = df.select(F.explode(F.array(*columns)).alias("label"))
    return labels.dropna().distinct()
