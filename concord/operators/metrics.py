"""Classification metrics from (truth, prediction) rows; every one is a count per cell first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUTH, PREDICTION = "truth", "prediction"


def valid_pairs(df: DataFrame, sentinel: str = "Error") -> DataFrame:
    """Rows with both labels and no failed prediction."""
    return df.dropna(subset=[TRUTH, PREDICTION]).filter(F.col(PREDICTION) != sentinel)


def hit_percent(hit: Column) -> Column:
    return F.lit(100.0) * F.count_if(hit) / F.count(F.lit(1))


def accuracy(df: DataFrame, keys: Sequence[str] = (), name: str = "accuracy") -> DataFrame:
    """Percent of rows whose prediction equals the truth, also per epoch or model."""
    return df.groupBy(*keys).agg(hit_percent(F.col(TRUTH) == F.col(PREDICTION)).alias(name))


def confusion(df: DataFrame) -> DataFrame:
    """Non-zero cells of the confusion matrix."""
    return df.groupBy(TRUTH, PREDICTION).agg(F.count(F.lit(1)).alias("n"))


def confusion_dense(df: DataFrame) -> DataFrame:
    """All cells over the labels of truth and prediction, zeros included: labels² rows by definition.

    Each label's row of zeros is made where the label is, so the matrix is
    spread over tasks; only the list of labels is held as one value. Without
    need for the zeros, ``confusion`` is the form to use.
    """
    cells = confusion(df)
    # The filter keeps the counts in this branch, so both branches share one aggregation.
    labels = cells.filter("n > 0").select(F.explode(F.array(TRUTH, PREDICTION)).alias(TRUTH)).distinct()
    axis = labels.agg(F.collect_list(TRUTH)).scalar()
    empty = labels.select(TRUTH, F.explode(axis).alias(PREDICTION), F.lit(0).cast("bigint").alias("n"))
    return cells.unionByName(empty).groupBy(TRUTH, PREDICTION).agg(F.sum("n").alias("n"))


def class_report(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label of truth or prediction, 0 where undefined."""
    cells = df.groupBy(*keys, TRUTH, PREDICTION).agg(F.count(F.lit(1)).alias("n"))
    return report_from_cells(cells, keys).drop("tp")


def report_from_cells(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """As ``class_report`` from counted (truth, prediction) cells, with the hits as ``tp``."""
    hit = F.when(F.col(TRUTH) == F.col(PREDICTION), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")

    def side(label: str, tp: Column, support: Column, predicted: Column) -> Column:
        counts = [tp.alias("tp"), support.alias("support"), predicted.alias("predicted")]
        return F.struct(F.col(label).alias("label"), *counts)

    both = F.array(side(TRUTH, hit, F.col("n"), none), side(PREDICTION, none, none, F.col("n")))
    sums = (
        cells.select(*keys, F.inline(both))
        .groupBy(*keys, "label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    )
    return sums.select(
        *keys,
        "label",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(F.col("tp") * 2, F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "tp",
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


MACRO = ("precision", "recall", "f1")


def macro_scores(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean over the labels of precision, recall and F1, in percent."""
    means = [(F.avg(c) * 100.0).alias(f"macro_{c}") for c in MACRO]
    return class_report(df, keys).groupBy(*keys).agg(*means)
