"""Exact, repeatable splits and samples, on any keys.

Rows are ordered by the md5 of key and seed, then the key, then a hash of the
whole row. The cut is found from counts: first which bucket of hashes holds it,
then which key of that bucket, then, if only some of that key's rows are
taken, in the same way which rows. Each row is then judged on its own against
the cut: the data itself is never shuffled or sorted. Null keys are a key like
others. Rows that are equal in all columns and straddle the cut are counted and
given out by number. Columns need types that can be hashed and grouped: no maps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

# Hash buckets are named by this many hex digits. The one bucket whose keys are counted holds
# 1/16**DIGITS of them, about a million of 10**11.
DIGITS = 4


def _hashed(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("\0null")), F.lit(f":{seed}")))


def _row_hash(df: DataFrame) -> Column:
    return F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))


def _before(sizes: DataFrame, order: list[str], wanted: Column) -> Row | None:
    """The row of ``sizes`` (a count ``n`` each) that holds the ``wanted``-th of all, with how many are before it."""
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranks = sizes.select(
        "*", (F.sum("n").over(running) - F.col("n")).alias("before"), wanted(F.sum("n").over(everything)).alias("wanted")
    )
    return ranks.filter((F.col("before") < F.col("wanted")) & (F.col("wanted") <= F.col("before") + F.col("n"))).first()


def _nth(rows: DataFrame, hashed: str, others: list[str], wanted: Callable[[Column], Column], digits: int) -> Row | None:
    """The value of (hashed, others) that the ``wanted``-th row has, its rows, and how many come before them.

    Counts of hash buckets, at most 16**digits, tell the bucket, and counts of the values in it the value.
    """
    named = rows.withColumn("_bucket", F.substring(hashed, 1, digits))
    bucket = _before(named.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")), ["_bucket"], wanted)
    if bucket is None:
        return None
    inside = named.filter(F.col("_bucket") == bucket["_bucket"]).groupBy(hashed, *others).agg(F.count(F.lit(1)).alias("n"))
    return _before(inside, [hashed, *others], lambda n: F.lit(bucket["wanted"] - bucket["before"]))


@dataclass
class Cut:
    """Rows before (h, k, r) are taken, and ``taken`` of the ``rows`` equal rows there."""

    h: str
    k: object
    r: str
    taken: int
    rows: int


def _cut(df: DataFrame, key: str, seed: int, wanted: Callable[[Column], Column], digits: int) -> Cut | None:
    rows = df.select(_hashed(key, seed).alias("h"), F.col(key).alias("k"))
    found = _nth(rows, "h", ["k"], wanted, digits)
    if found is None:
        return None
    taken = found["wanted"] - found["before"]
    if taken == found["n"]:
        return Cut(found["h"], found["k"], "~", 0, 0)  # after all hashes in hex: the whole key is taken
    own = df.filter(F.col(key).eqNullSafe(F.lit(found["k"]))).select(_row_hash(df).alias("r"))
    row = _nth(own, "r", [], lambda n: F.lit(taken), digits)
    return Cut(found["h"], found["k"], row["r"], row["wanted"] - row["before"], row["n"])


def _marked(df: DataFrame, key: str, seed: int, wanted: Callable[[Column], Column], digits: int) -> DataFrame:
    """``df`` with ``_taken``; true for exactly as many rows as wanted."""
    cut = _cut(df, key, seed, wanted, digits)
    if cut is None:
        return df.withColumn("_taken", F.lit(False))
    place = F.struct(_hashed(key, seed).alias("h"), F.col(key).alias("k"))
    edge = F.struct(F.lit(cut.h).alias("h"), F.lit(cut.k).cast(df.schema[key].dataType).alias("k"))
    own = _hashed(key, seed).eqNullSafe(F.lit(cut.h)) & F.col(key).eqNullSafe(F.lit(cut.k))
    if cut.r == "~":
        return df.withColumn("_taken", own | (place < edge))
    if cut.taken == cut.rows:
        return df.withColumn("_taken", F.when(own, _row_hash(df) <= cut.r).otherwise(place < edge))
    straddles = own & (_row_hash(df) == cut.r)
    others = df.filter(~straddles).withColumn("_taken", F.when(own, _row_hash(df) < cut.r).otherwise(place < edge))
    # rows equal in all columns: one row each with its count, of which the first ``taken`` go in
    equal = df.filter(straddles).groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.orderBy(*[F.col(f"`{c}`") for c in df.columns]).rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(0), F.lit(cut.taken) - F.coalesce(F.sum("_n").over(along), F.lit(0)))
    parts = F.array(
        F.struct(F.lit(True).alias("taken"), F.least("_n", "_room").alias("n")),
        F.struct(F.lit(False).alias("taken"), F.greatest(F.lit(0), F.col("_n") - F.col("_room")).alias("n")),
    )
    copies = equal.withColumn("_room", room).withColumn("_part", F.explode(parts)).filter("_part.n > 0")
    copies = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_part.n"))))
    return others.unionByName(copies.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_part.taken").alias("_taken")))


def split(df: DataFrame, key: str, train_share: float = 0.8, seed: int = 42, digits: int = DIGITS) -> DataFrame:
    """Adds ``subset``: exactly ``int(train_share * n)`` rows are ``train``, the rest ``test``."""
    marked = _marked(df, key, seed, lambda n: F.floor(F.lit(train_share) * n), digits)
    return marked.withColumn("subset", F.when(F.col("_taken"), F.lit("train")).otherwise(F.lit("test"))).drop("_taken")


def sample(df: DataFrame, key: str, n: int, seed: int = 42, digits: int = DIGITS) -> DataFrame:
    """Exactly ``n`` rows without replacement, or all rows when there are no more."""
    return _marked(df, key, seed, lambda total: F.least(F.lit(n), total), digits).filter("_taken").drop("_taken")
