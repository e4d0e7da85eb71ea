"""Joins of rows with summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, summary: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with a summary, keys compared null-safe.

    An ordinary join: at run time Spark turns it into a broadcast if the
    summary proves small enough, and else splits a hot key of ``df``.
    """
    left, right = df.alias("l"), summary.alias("r")
    same = F.lit(True)
    for key in on:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    joined = left.join(right, same, how)
    if how in ("left_semi", "left_anti"):
        return joined
    added = [F.col(f"r.`{c}`") for c in summary.columns if c not in on]
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], *added)
