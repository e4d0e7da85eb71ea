"""Mixing sources to target weights: a van der Corput schedule over blocks of equal size.

Only DataFrame functions. Each source's documents are shuffled (by a hash of
their id) into one stream of words and cut into blocks of ``BLOCK`` words. A
source may fill as many slots as its target has blocks; cumulative quotas are
its stretch of [0, 1), and slot ``t`` goes to the source in whose stretch the
bit reversal of ``t`` falls, so every part of the schedule is mixed alike. The
n-th slot of a source takes its n-th block, over again after the last one, and
a document takes the words of its blocks.

Hot sources: all sums and positions are formed in two steps, by (source, slice
of the hash or of the slots) and then along one row a slice, so no task holds
a source. Sources themselves are one row each in one window.

Defined results: null texts have no words and take none; a null source is the
last source; null ids are shuffled as one more id; rows that repeat an id are
documents of their own, equal ones are counted first and spread out again; an
empty table gives no rows, and with no words at all targets are 0. Only the
three named columns are read, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import WORD, n_tasks, text_or_empty, written

#: Weights by turn, and how often a document may be taken.
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3

BLOCK = 32
SLICES = 4096
#: Masks of the steps that reverse 64 bits: neighbours, pairs, nibbles, bytes, ...
SWAPS = ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F))
SWAPS += ((8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))


def reversed_bits(v: Column, bits: Column) -> Column:
    """The lowest ``bits`` of ``v`` in reverse order, the rest being zero."""
    for by, mask in SWAPS:
        v = F.shiftrightunsigned(v, by).bitwiseAND(mask).bitwiseOR(F.shiftleft(v.bitwiseAND(mask), by))
    return F.call_function("shiftrightunsigned", v, 64 - bits)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the number of equal rows, written once: texts are read a single time."""
    rows = docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"))
    rows = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    at = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return written(rows.withColumn("at", at).withColumn("slice", F.conv(F.substring("at", 1, 3), 16, 10).cast("int")))


def targets(slices: DataFrame) -> DataFrame:
    """One row per source: number, size, target and quota of blocks with its place among all quotas.

    Raising one level for all weights until the shares fill the whole, with a
    source's share stopping at its cap, ends where resharing the excess ends.
    """
    sources = slices.groupBy("source").agg(F.sum("words").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    sources = sources.withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST_EPOCHS)
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    sources = sources.withColumn("level", left / F.sum("weight").over(after))
    capped = F.col("cap") / F.col("weight") <= F.col("level")
    share = F.col("weight") * F.max("level").over(everything)
    sources = sources.withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(share))
    # whole epochs, then as many blocks of the last one as come nearest
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    epochs = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    rest = F.round((F.col("target") - epochs * F.col("source_size")) / F.greatest(F.least("source_size", F.lit(BLOCK)), F.lit(1)))
    quota = epochs * F.col("blocks") + F.least(rest.cast("long"), F.col("blocks"))
    sources = sources.withColumn("quota", quota)
    placed = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("first", F.coalesce(F.sum("quota").over(placed), F.lit(0)))
    bits = F.ceil(F.log2(F.greatest(F.sum("quota").over(everything), F.lit(1)).cast("double"))).cast("int")
    return sources.withColumn("bits", bits).select(
        "source", "sid", "source_size", "target", "blocks", "quota", "first", "bits"
    )


def schedule(sources: DataFrame) -> DataFrame:
    """slot, sid, rank, epoch and block: the n-th slot of a source takes its n-th block."""
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / SLICES)))
    points = sources.filter("quota > 0").select("sid", "blocks", "quota", "first", "bits", parts.alias("part"))
    points = points.repartition(n_tasks(sources.sparkSession), "sid", "part")
    low = F.col("part") * SLICES
    inside = F.explode(F.sequence(low, F.least(low + SLICES, F.col("quota")) - 1))
    points = points.select("sid", "blocks", "first", "bits", inside.alias("n"))
    slot = reversed_bits(F.col("first") + F.col("n"), F.col("bits"))
    slots = points.select("sid", "blocks", slot.alias("slot")).withColumn("slice", F.floor(F.col("slot") / SLICES))
    held = slots.groupBy("sid", "slice").agg(F.count("*").alias("held"))
    along = Window.partitionBy("sid").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("sid", "slice", F.coalesce(F.sum("held").over(along), F.lit(0)).alias("earlier"))
    rank = F.row_number().over(Window.partitionBy("sid", "slice").orderBy("slot")) - 1 + F.col("earlier")
    slots = slots.join(held.hint("merge"), ["sid", "slice"]).withColumn("rank", rank)
    epoch = F.floor(F.col("rank") / F.col("blocks"))
    return slots.select("slot", "sid", "rank", epoch.alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block"))


def placed(rows: DataFrame, slices: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per document with its first word's position in the stream of its source."""
    along = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = slices.withColumn("earlier", F.coalesce(F.sum("words").over(along), F.lit(0)))
    sources = sources.withColumnRenamed("source", "named")
    firsts = firsts.join(sources, F.col("source").eqNullSafe(F.col("named")))
    firsts = firsts.select("named", F.col("slice").alias("sliced"), "earlier", "sid", "source_size", "target")
    key = F.col("source").eqNullSafe(F.col("named")) & (F.col("slice") == F.col("sliced"))
    words = F.sum(F.col("size") * F.col("copies"))
    inside = Window.partitionBy("sid", "slice").orderBy("at", "doc_id", "size")
    before = words.over(inside.rowsBetween(Window.unboundedPreceding, -1))
    first = F.col("earlier") + F.coalesce(before, F.lit(0))
    found = rows.join(firsts.hint("merge"), key).withColumn("first", first)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    first = F.col("first") + F.col("copy") * F.col("size")
    return found.select("doc_id", "source", "size", "copy", "sid", "source_size", "target", first.alias("first"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken words; ``copy`` counts rows equal in the first three."""
    rows = sized(docs)
    slices = rows.groupBy("source", "slice").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    slices = written(slices)
    sources = written(targets(slices))
    times = schedule(sources).groupBy("sid", "block").agg(F.count("*").alias("times"))
    documents = placed(rows, slices, sources)
    first, size = F.col("first"), F.col("size")
    last = first + size - 1
    none = F.array().cast("array<bigint>")
    blocks = F.when(size > 0, F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK))).otherwise(none)
    pieces = documents.withColumn("block", F.explode_outer(blocks))
    inside = F.least(last + 1, (F.col("block") + 1) * BLOCK) - F.greatest(first, F.col("block") * BLOCK)
    pieces = pieces.withColumn("words", inside).join(times.hint("merge"), ["sid", "block"], "left")
    taken = F.sum(F.coalesce(F.col("words") * F.col("times"), F.lit(0))).alias("taken")
    keys = ["sid", "source", "doc_id", "size", "copy", "source_size", "target"]
    return pieces.groupBy(keys).agg(taken).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "copy"
    )
