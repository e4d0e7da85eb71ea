"""Latency, timing trials and energy from sampled power.

Order-dependent figures never sort a whole model in one task: rows are cut
into slices along the order, each slice gives a partial result, and only the
slice edges are put in order. A row's slice follows from its own values, so
the rows themselves are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import text
from concord.functions.cleaning import eps_ratio, per_second, safe_ratio
from concord.operators.ordering import SLICE, sliced
from concord.operators.small import attach

MODEL = "model"


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def latency_throughput(
    votes: DataFrame, failed: Column | None = None, include_failures: bool = False, eps: float | None = None
) -> DataFrame:
    """Mean latency per voter and items per second; failed rows left out unless asked for."""
    rows = votes if include_failures or failed is None else votes.filter(~failed)
    mean = rows.groupBy(MODEL).agg(F.avg("latency_s").alias("mean_latency_s"))
    rate = F.lit(1.0) / F.col("mean_latency_s") if eps is None else eps_ratio(F.lit(1.0), F.col("mean_latency_s"), eps)
    return mean.withColumn("throughput", rate)


def quantiles(df: DataFrame, value: str, shares: Sequence[float], names: Sequence[str], key: str = MODEL) -> DataFrame:
    """Exact, linearly interpolated quantiles per key, for groups of any size.

    ``percentile`` would hold all distinct values of a group in one task. Here
    equal values are counted first, so one that holds much of a group is a
    single row; the values are cut into slices, slice sizes tell which of
    them hold the wanted ranks, and only those are sorted.
    """
    present = df.select(key, value).dropna(subset=[value]).groupBy(key, value).agg(F.count(F.lit(1)).alias("times"))
    marked = sliced(present, [key], [value])
    sizes = marked.groupBy(key, SLICE).agg(F.sum("times").alias("size"))
    # One row per key and slice.
    slices = Window.partitionBy(key).orderBy(SLICE)
    placed = sizes.select(
        key,
        SLICE,
        (F.sum("size").over(slices) - F.col("size")).alias("before"),
        "size",
        F.sum("size").over(Window.partitionBy(key)).alias("n"),
    )
    ranks = [
        text.struct(edge=text.literal(f"{name}_{edge}"), rank=f"bigint({edge}({share}D * (n - 1))) + 1 - before")
        for name, share in zip(names, shares)
        for edge in ("floor", "ceil")
    ]
    wanted = (
        placed.selectExpr(text.name(key), SLICE, "size", "n", f"array({', '.join(ranks)}) as ranks")
        .selectExpr(text.name(key), SLICE, "n", "filter(ranks, r -> r.rank between 1 and size) as ranks")
        .filter("size(ranks) > 0")
    )
    upto = F.sum("times").over(Window.partitionBy(SLICE, key).orderBy(value))
    numbered = attach(marked, wanted, [SLICE, key]).withColumn("upto", upto)
    found = numbered.select(key, "n", F.col(value).alias("value"), "upto", "times", F.explode("ranks").alias("r"))
    found = found.filter("r.rank between upto - times + 1 and upto")
    edges = found.groupBy(key).agg(
        F.max("n").alias("n"),
        *[
            F.expr(f"max(case when r.edge = {text.literal(f'{name}_{edge}')} then value end) as {name}_{edge}")
            for name in names
            for edge in ("floor", "ceil")
        ],
    )
    return edges.selectExpr(
        text.name(key),
        *[
            f"{name}_floor + ({name}_ceil - {name}_floor) * ({share}D * (n - 1) - floor({share}D * (n - 1))) as {name}"
            for name, share in zip(names, shares)
        ],
    )


def box_stats(df: DataFrame, value: str, key: str = MODEL, approx: bool = False) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and outlier count per key."""
    names, shares = ["q1", "median", "q3"], [0.25, 0.5, 0.75]
    if approx:
        cells = [F.percentile_approx(value, share, 10000).cast("double").alias(n) for n, share in zip(names, shares)]
        quartiles = df.groupBy(key).agg(*cells)
    else:
        quartiles = quantiles(df, value, shares, names, key)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        attach(df.select(key, value), quartiles, [key])
        .groupBy(key)
        .agg(
            *[F.max(n).alias(n) for n in names],
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def trial_stats(trials: DataFrame, warmup: int = 15, runs: int = 50, repeats: int | None = None) -> DataFrame:
    """Mean and population std over repeats of the mean latency of ``runs`` trials after warm-up.

    Only whole repeats count: trials after the last one are left out.
    ``throughput`` follows from the mean latency; ``throughput_mean`` and
    ``throughput_std`` are over the throughput of each repeat.
    """
    after = F.col("iter") - warmup - 1
    rows = trials.select(MODEL, "ms", F.floor(after / runs).alias("repeat")).filter(after >= 0)
    if repeats is not None:
        rows = rows.filter(F.col("repeat") < repeats)
    whole = rows.groupBy(MODEL, "repeat").agg(F.avg("ms").alias("ms"), F.count(F.lit(1)).alias("n"))
    means = whole.filter(F.col("n") == runs).withColumn("rate", per_second(F.col("ms")))
    return (
        means.groupBy(MODEL)
        .agg(
            F.avg("ms").alias("latency_mean_ms"),
            F.stddev_pop("ms").alias("latency_std_ms"),
            F.avg("rate").alias("throughput_mean"),
            F.stddev_pop("rate").alias("throughput_std"),
        )
        .withColumn("throughput", per_second(F.col("latency_mean_ms")))
    )


def peak(df: DataFrame, gauge: str, key: str = MODEL) -> DataFrame:
    return df.groupBy(key).agg(F.max(gauge).alias("peak"))


def energy(
    samples: DataFrame,
    time: str = "micros",
    power: str = "power_w",
    tie: str = "event_id",
    idle_w: Column | None = None,
    ticks_per_second: float = 1e6,
    total_time_s: float = 0.0,
) -> DataFrame:
    """Energy per model by the trapezoid rule over its power samples.

    Gives mean and max power, total energy and, given an idle power, net
    energy of ``max(0, power - idle)``. A model with a single sample has no
    area: it counts as idle for ``total_time_s``.

    Samples are cut into range slices by (model, time, tie). A slice sums its own
    areas, then the gaps between neighbouring slices are bridged from their
    first and last samples.
    """
    idle = F.lit(0.0) if idle_w is None else idle_w
    rows = samples.select(MODEL, F.col(time).alias("t"), F.col(tie).alias("tie"), F.col(power).alias("p"))
    rows = rows.withColumn("idle", idle).withColumn("net", F.greatest(F.lit(0.0), F.col("p") - F.col("idle")))
    along = Window.partitionBy(SLICE, MODEL).orderBy("t", "tie")
    point = F.struct("t", "tie", "p", "net")

    def area(before: Column, after: Column, field: str) -> Column:
        seconds = (after["t"] - before["t"]) / F.lit(ticks_per_second)
        return (before[field] + after[field]) / 2.0 * seconds

    marked = sliced(rows, [MODEL], ["t", "tie"]).withColumn("at", point)
    inner = marked.withColumn("prev", F.lag("at").over(along))
    partial = inner.groupBy(MODEL, SLICE).agg(
        F.sum(area(F.col("prev"), F.col("at"), "p")).alias("gross"),
        F.sum(area(F.col("prev"), F.col("at"), "net")).alias("net"),
        F.sum("p").alias("sum_p"),
        F.max("p").alias("max_p"),
        F.max("idle").alias("idle"),
        F.count(F.lit(1)).alias("n"),
        F.min("at").alias("first"),
        F.max("at").alias("last"),
    )
    # One row per model and slice.
    slices = Window.partitionBy(MODEL).orderBy(SLICE)
    bridged = partial.withColumn("prev", F.lag("last").over(slices))

    def total(name: str, field: str) -> Column:
        gap = F.coalesce(area(F.col("prev"), F.col("first"), field), F.lit(0.0))
        return F.sum(F.coalesce(F.col(name), F.lit(0.0)) + gap).alias(name)

    sums = bridged.groupBy(MODEL).agg(
        total("gross", "p"),
        total("net", "net"),
        (F.sum("sum_p") / F.sum("n")).alias("mean_p"),
        F.max("max_p").alias("max_p"),
        F.max("idle").alias("idle"),
        F.sum("n").alias("n_samples"),
    )
    single = F.col("n_samples") <= 1
    return sums.select(
        MODEL,
        "n_samples",
        F.when(single, F.col("idle")).otherwise(F.col("mean_p")).alias("mean_power_w"),
        F.when(single, F.col("idle")).otherwise(F.col("max_p")).alias("max_power_w"),
        F.when(single, F.col("idle") * total_time_s).otherwise(F.col("gross")).alias("energy_j"),
        F.when(single, F.lit(0.0)).otherwise(F.col("net")).alias("net_energy_j"),
    )


def idle_power(samples: DataFrame, power: str = "power_w") -> Column:
    """Mean power of idle samples as a scalar, 0 without any."""
    return samples.agg(F.coalesce(F.avg(power), F.lit(0.0)).alias("idle")).scalar()


def per_item_energy(energy_j: Column, n_items: Column, digits: int = 3) -> Column:
    """Millijoules per item."""
    return F.round(safe_ratio(energy_j * 1000.0, n_items), digits)


def per_watt(figure: Column, mean_power_w: Column, digits: int = 3) -> Column:
    """Accuracy or throughput per watt of mean power, 0 without power."""
    return F.round(safe_ratio(figure, mean_power_w), digits)
