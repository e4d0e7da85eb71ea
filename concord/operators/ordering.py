"""Row numbers and first-of-key without ordering a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.operators.small import attach

SLICE = "_slice"
#: Rows of a key from which on it is cut, and slices it is cut into at most.
LARGE, SLICES = 100_000, 256
#: Sampled rows a slice.
SAMPLED = 50
#: Shares of the rows are told by this many values of a hash.
SHARES = 1 << 30


def cuts(df: DataFrame, keys: Sequence[str], order: Sequence[str], large: int | None = None, n: int = SLICES) -> DataFrame:
    """``keys, points``: for each large key, rising places along ``order`` at which to cut it.

    A place is a value of all ``order`` columns, so rows that share the first of
    them are cut by the others. Rows are sampled by a hash of their place,
    which makes the points the same in every run; a key gives a sample of
    bounded size, and keys that need no cut give nothing.
    """
    large = LARGE if large is None else large
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > large)
    sizes = sizes.withColumn("_parts", F.least(F.lit(n), F.ceil(F.col("_n") / large).cast("int") + 1))
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    rows = attach(df.select(*keys, place.alias("_at")), sizes, list(keys))
    share = F.least(F.lit(1.0), F.lit(float(SAMPLED)) * F.col("_parts") / F.col("_n"))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(11), "_at"), F.lit(SHARES)) < share * SHARES)
    found = sample.groupBy(*keys).agg(F.sort_array(F.collect_set("_at")).alias("_all"), F.first("_parts").alias("_parts"))
    step = F.size("_all") / F.col("_parts")
    chosen = F.transform(
        F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: F.element_at("_all", F.least(F.size("_all"), F.ceil(i * step).cast("int")))
    )
    return found.select(*keys, F.array_distinct(chosen).alias("_points"))


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], large: int | None = None, n: int = SLICES) -> DataFrame:
    """Rows marked with their slice along ``order`` within ``keys``, numbered like the values; equal rows share one.

    The points to cut at are a table of the large keys, joined by key. A row
    finds its slice among them by binary search.
    """
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    marked = attach(df, cuts(df, keys, order, large, n), list(keys), "left").withColumn("_at", place)
    steps = F.lit([1 << b for b in range(n.bit_length(), -1, -1)])

    def further(at: Column, step: Column) -> Column:
        return F.when((at + step <= F.size("_points")) & (F.get("_points", at + step - 1) < F.col("_at")), at + step).otherwise(at)

    below = F.when(F.col("_points").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), further))
    return marked.withColumn(SLICE, below).drop("_at", "_points")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Row number from 1 within ``keys`` along ``order``, exact for groups of any size.

    Rows are numbered inside slices of each key and shifted by the sizes of
    its earlier slices, so the rows move once, by key and slice.
    """
    marked = sliced(df, keys, order)
    sizes = marked.groupBy(SLICE, *keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = Window.partitionBy(SLICE, *keys).orderBy(*order)
    numbered = attach(marked.withColumn("_inside", F.row_number().over(inside)), shifts, [SLICE, *keys])
    return numbered.select(*df.columns, (F.col("_inside") + F.col("_shift")).alias(name))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row per key along ``order``; an aggregation, so hot keys combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return df.groupBy(*keys).agg(first).select(*keys, "first.*").select(*df.columns)
