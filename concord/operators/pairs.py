"""Agreement between pairs of voters and co-occurrence of labels.

No item ever emits its pairs as rows: voters are compared by bit matrices where
the votes are, and only a count a pair and task is shuffled. Plans are the
same for seven voters and for hundreds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import text
from concord.functions.rules import lookup
from concord.operators import bits
from concord.operators.consensus import family_means, record_count
from concord.operators.votes import ITEM, LABEL, MODEL, aligned


def pair_counts(wide: DataFrame, voters: Sequence[str], own: bool = False) -> DataFrame:
    """Per pair of voters, the items both voted on and those they agree on; from the wide table.

    With ``own`` each voter is also paired with itself, which counts its votes.
    """
    names = F.lit(list(voters))
    counts = bits.pairs_of_wide(wide, voters)
    return counts.filter("i <= j" if own else "i < j").select(
        F.element_at(names, F.col("i").cast("int") + 1).alias("model_a"),
        F.element_at(names, F.col("j").cast("int") + 1).alias("model_b"),
        "n_both",
        "n_same",
    )


def pair_counts_long(votes: DataFrame, own: bool = False) -> DataFrame:
    """As ``pair_counts`` from the long table, for voters that are not known; pairs with a common item, by name."""
    counts = bits.pairs_of_long(votes, ITEM, MODEL, LABEL)
    return counts if own else counts.filter("model_a < model_b")


def _matrix(pairs: DataFrame, rate: Column) -> DataFrame:
    """Both triangles and the diagonal from pairs that include each voter with itself."""
    rows = pairs.withColumn("agreement", rate)
    one = text.struct(model_a="model_a", model_b="model_b", agreement="agreement")
    other = text.struct(model_a="model_b", model_b="model_a", agreement="agreement")
    return rows.selectExpr(f"inline(if(model_a = model_b, array({one}), array({one}, {other})))")


def _on_diagonal(value: float, elsewhere: Column) -> Column:
    return F.when(F.col("model_a") == F.col("model_b"), F.lit(float(value))).otherwise(elsewhere)


def agreement_matrix(wide: DataFrame, voters: Sequence[str], scale: float = 100.0) -> DataFrame:
    """Symmetric agreement over the items both voted on; 0 without overlap, diagonal full."""
    rate = F.when(F.col("n_both") > 0, F.lit(scale) * F.col("n_same") / F.col("n_both")).otherwise(F.lit(0.0))
    return _matrix(pair_counts(wide, voters, own=True), _on_diagonal(scale, rate))


def agreement_matrix_long(votes: DataFrame, scale: float = 100.0) -> DataFrame:
    """As ``agreement_matrix`` from the long table, over the voters that are found; pairs without overlap have no row."""
    rate = F.lit(scale) * F.col("n_same") / F.col("n_both")
    return _matrix(pair_counts_long(votes, own=True), _on_diagonal(scale, rate))


def agreement_all_rows(
    wide: DataFrame, voters: Sequence[str], listing: DataFrame, diagonal: str = "full"
) -> DataFrame:
    """Symmetric agreement in percent of all records, a missing vote being a disagreement.

    The diagonal is 100, or with ``diagonal="coverage"`` the share of records
    the voter answered.
    """
    rate = F.lit(100.0) * F.col("n_same") / record_count(listing)
    wide = aligned(wide, listing)
    return _matrix(pair_counts(wide, voters, own=True), _on_diagonal(100.0, rate) if diagonal == "full" else rate)


def intra_family(
    wide: DataFrame, listing: DataFrame, family_of: Mapping[str, str], families: Sequence[str]
) -> DataFrame:
    """Mean all-rows agreement inside each family; 100 for one voter, 0 for none."""
    rates = []
    for family in families:
        members = [v for v, f in family_of.items() if f == family]
        if len(members) < 2:
            rates.append((family, 100.0 if members else 0.0))
    fixed = wide.sparkSession.createDataFrame(rates, "family string, intra_pct double")
    paired = [f for f in families if f not in dict(rates)]
    voters = [v for v, f in family_of.items() if f in paired]
    if not voters:
        return fixed
    first = lookup(F.col("model_a"), family_of)
    pairs = (
        pair_counts(aligned(wide, listing), voters)
        .filter(first == lookup(F.col("model_b"), family_of))
        .withColumn("intra_pct", F.lit(100.0) * F.col("n_same") / record_count(listing))
    )
    return family_means(pairs, "intra_pct", first, paired).unionByName(fixed)


def label_overlap(votes: DataFrame, top: DataFrame) -> DataFrame:
    """Items per ordered pair of labels, itself included, both among the ``top`` labels.

    The label set of an item is bounded by the top list; equal sets are
    counted first, so pairs are formed once per distinct set.
    """
    sets = (
        votes.join(top.select(LABEL), LABEL, "left_semi")
        .groupBy(ITEM)
        .agg(F.sort_array(F.collect_set(LABEL)).alias("labels"))
        .groupBy("labels")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    return (
        sets.select("weight", "labels", F.explode("labels").alias("label_a"))
        .select("weight", "label_a", F.explode("labels").alias("label_b"))
        .groupBy("label_a", "label_b")
        .agg(F.sum("weight").alias("n"))
    )
