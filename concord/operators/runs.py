"""Summaries of benchmark runs: means, spreads, best rows, scores and energy figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import fixed_values as fixed
from concord.functions.cleaning import eps_ratio
from concord.functions.rules import lookup
from concord.operators.votes import only_listed

DATASET, MODEL = "dataset", "model"


def run_means(
    runs: DataFrame, metrics: Sequence[str], keys: Sequence[str] = (DATASET, MODEL), digits: int = 2
) -> DataFrame:
    """Rounded mean of each metric over repeated runs."""
    return runs.groupBy(*keys).agg(*[F.round(F.avg(m), digits).alias(m) for m in metrics])


def mean_std(runs: DataFrame, metrics: Sequence[str], keys: Sequence[str] = (DATASET, MODEL)) -> DataFrame:
    """Mean and sample standard deviation of each metric."""
    cells = []
    for m in metrics:
        cells += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return runs.groupBy(*keys).agg(*cells)


def best_by(summary: DataFrame, highest: Sequence[str] = (), lowest: Sequence[str] = ()) -> DataFrame:
    """Per metric the row with its best value, the first (dataset, model) on ties."""
    cells = []
    for metric in (*highest, *lowest):
        ascending = F.col(metric) if metric in lowest else -F.col(metric)
        key = F.when(F.col(metric).isNotNull(), F.struct(ascending, DATASET, MODEL))
        cells.append(F.min_by(F.struct(F.lit(metric).alias("metric"), DATASET, MODEL, F.col(metric).alias("value")), key))
    best = summary.agg(*[c.alias(f"best_{i}") for i, c in enumerate(cells)])
    return best.select(F.inline(F.array(*[f"best_{i}" for i in range(len(cells))])))


def datasets_of(runs: DataFrame) -> list[str]:
    """Sorted dataset names; costs a job and brings one name per dataset."""
    return [row[0] for row in runs.select(DATASET).distinct().orderBy(DATASET).collect()]


def metric_pivot(runs: DataFrame, metric: str, datasets: Sequence[str] | None, mean_name: str) -> DataFrame:
    """Model by dataset means, with the mean over the cells a model has, best first.

    Without a list the datasets are those that occur; with one, a dataset
    outside it fails the query by name.
    """
    datasets = datasets_of(runs) if datasets is None else datasets
    cells = only_listed(runs, DATASET, datasets).groupBy(MODEL).pivot(DATASET, list(datasets)).agg(F.avg(metric))
    present = F.filter(F.array(*[F.col(f"`{d}`") for d in datasets]), lambda x: x.isNotNull())
    mean = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))
    return cells.withColumn(mean_name, mean).orderBy(F.desc_nulls_last(mean_name), MODEL)


def weighted_scores(
    summary: DataFrame,
    accuracy: str = "accuracy",
    latency: str = "latency_ms",
    weights: Mapping[str, tuple[float, float]] = fixed.SCORE_WEIGHTS,
    eps: float = fixed.EPSILON,
) -> DataFrame:
    """Weighted sums of min-max normalised accuracy and inverse latency, one per scenario."""
    inverse = eps_ratio(F.lit(1.0), F.col(latency), eps)
    ranges = summary.agg(
        F.struct(
            F.min(accuracy).alias("a_min"),
            F.max(accuracy).alias("a_max"),
            F.min(inverse).alias("l_min"),
            F.max(inverse).alias("l_max"),
        ).alias("r")
    ).scalar()
    ranged = summary.withColumn("_r", ranges).withColumn("_inverse", inverse)
    a = eps_ratio(F.col(accuracy) - F.col("_r.a_min"), F.col("_r.a_max") - F.col("_r.a_min"), eps)
    l = eps_ratio(F.col("_inverse") - F.col("_r.l_min"), F.col("_r.l_max") - F.col("_r.l_min"), eps)
    scores = [(F.lit(wa) * a + F.lit(wl) * l).alias(name) for name, (wa, wl) in weights.items()]
    return ranged.select(*summary.columns, *scores)


def efficiency_score(runs: DataFrame, accuracy: str = "accuracy", throughput: str = "throughput") -> DataFrame:
    """Mean accuracy times mean throughput over 1000, each a mean over datasets of run means."""
    per_dataset = runs.groupBy(DATASET, MODEL).agg(F.avg(accuracy).alias("a"), F.avg(throughput).alias("t"))
    return (
        per_dataset.groupBy(MODEL)
        .agg(F.avg("a").alias("mean_accuracy"), F.avg("t").alias("mean_throughput"))
        .withColumn("efficiency", F.col("mean_accuracy") * F.col("mean_throughput") / 1000.0)
    )


def energy_columns(runs: DataFrame, watts: Mapping[str, float] = fixed.ASSUMED_WATTS) -> DataFrame:
    """Energy figures from an assumed power per model; null where no power is known."""
    power = F.col("avg_power_w")
    throughput = F.col("throughput")
    return (
        runs.withColumn("avg_power_w", lookup(F.col(MODEL), watts))
        .withColumn("energy_j", power * F.col("inference_time_s"))
        .withColumn("energy_per_image_mj", F.when(throughput != 0, power / throughput) * 1000.0)
        .withColumn("accuracy_per_watt", F.col("accuracy") / power)
        .withColumn("throughput_per_watt", throughput / power)
    )


#: Row order of a written energy table.
ENERGY_ORDER = (F.asc, DATASET), (F.desc, "accuracy"), (F.asc, "energy_j")


def in_energy_order(with_energy: DataFrame) -> DataFrame:
    """Sorted for a report, once, where it is written."""
    return with_energy.orderBy(*[order(column) for order, column in ENERGY_ORDER])


ENERGY_METRICS = [
    "accuracy",
    "throughput",
    "latency_ms",
    "avg_power_w",
    "energy_j",
    "energy_per_image_mj",
    "accuracy_per_watt",
    "throughput_per_watt",
]


def energy_summary(with_energy: DataFrame) -> DataFrame:
    """Mean of the energy figures per model."""
    return with_energy.groupBy(MODEL).agg(*[F.avg(m).alias(m) for m in ENERGY_METRICS])


def quality_gate(df: DataFrame, label: str, keys: Sequence[str] = (), min_classes: int = 5) -> DataFrame:
    """Record and class counts per dataset, and whether there are enough classes."""
    counts = [F.count(F.lit(1)).alias("n_records"), F.count_distinct(F.col(label)).alias("n_classes")]
    return df.groupBy(*keys).agg(*counts).withColumn("passes", F.col("n_classes") >= min_classes)


def assert_min_classes(df: DataFrame, label: str, min_classes: int = 5) -> DataFrame:
    """``df`` itself, unless it has no record or too few classes; costs a job."""
    gate = quality_gate(df, label, min_classes=min_classes).first()
    if not gate["n_records"]:
        raise ValueError("the dataset has no records")
    if not gate["passes"]:
        raise ValueError(f"only {gate['n_classes']} distinct classes, at least {min_classes} expected")
    return df


def against_mean(summary: DataFrame, metrics: Sequence[str], key: str = DATASET) -> DataFrame:
    """Each row's side, ``above`` or ``below``, of its dataset's mean per metric."""
    own = Window.partitionBy(key)  # a summary: one row per model and dataset
    sides: list[Column] = [
        F.when(F.col(m) >= F.avg(m).over(own), F.lit("above")).otherwise(F.lit("below")).alias(f"{m}_side")
        for m in metrics
    ]
    return summary.select(*summary.columns, *sides)


def table_rows(df: DataFrame, text: Sequence[str], numbers: Sequence[str], digits: int = 2, missing: str = "NaN") -> DataFrame:
    """Each row as a LaTeX table line, cells parted by ``&``."""
    cells = [F.col(c) for c in text] + [
        F.coalesce(F.when(F.col(f"`{c}`").isNotNull(), F.format_string(f"%.{digits}f", F.col(f"`{c}`"))), F.lit(missing))
        for c in numbers
    ]
    return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("line"))
