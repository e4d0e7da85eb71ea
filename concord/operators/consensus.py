"""Majority, agreement and divergence of votes.

Three frames build on each other: ``votes`` (long or wide), the *consensus*
(one row per item: ``majority, top_votes, n_votes, n_labels``) and the *judged*
votes (one row per vote: its item's consensus and ``n_label``, the voters that
gave the same label). Rates over *all* records take their denominator from the
record listing, one row per record, and count votes of listed records alone;
``restricted`` says that all rows given are of such records already.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import fixed_values as fixed
from concord.functions import text
from concord.functions.rules import lookup
from concord.operators.votes import ITEM, LABEL, MODEL, aligned, only_listed


#: The columns of a consensus besides the item.
CONSENSUS = ("majority", "top_votes", "n_votes", "n_labels")


def record_count(listing: DataFrame) -> Column:
    """Number of records as a scalar subquery; a bare parquet count reads only metadata."""
    return listing.agg(F.count(F.lit(1)).alias("n")).scalar()


def consensus(votes: DataFrame, tie: str = "label") -> DataFrame:
    """Per item: majority label, its votes, all valid votes and distinct labels.

    Ties go to the smallest label, or with ``tie="first_model"`` to the label
    whose earliest voter, by name, comes first. Without a valid vote the label
    is null and the counts are 0. Two aggregations with map-side combining.
    """
    first = [F.min(MODEL).alias("first")] if tie == "first_model" else []
    counts = votes.groupBy(ITEM, LABEL).agg(F.count(LABEL).alias("n"), *first)
    best = F.min(F.struct(-F.col("n"), *(["first"] if first else []), LABEL))
    return (
        counts.groupBy(ITEM)
        .agg(
            best.alias("best"),
            F.max("n").alias("top_votes"),
            F.sum("n").alias("n_votes"),
            F.count(LABEL).alias("n_labels"),
        )
        .select(ITEM, F.col("best")[LABEL].alias("majority"), "top_votes", "n_votes", "n_labels")
    )


def with_consensus(wide: DataFrame, voters: Sequence[str], tie: str = "label") -> DataFrame:
    """The wide table with each item's consensus beside it: row by row, nothing is moved.

    A label's rank is the number of cells without it, so the smallest wins.
    Missing votes are a label of their own that ranks behind all others.
    """
    n = len(voters)
    others = f"if(x is null, {n}, size(array_remove(_labels, x)))"
    order = "array_position(_labels, x) as first, " if tie == "first_model" else ""
    votes = " + ".join(f"int({text.name(v)} is not null)" for v in voters)
    return (
        wide.selectExpr("*", f"array({', '.join(map(text.name, voters))}) as _labels", f"{votes} as _votes")
        .selectExpr("*", "array_distinct(_labels) as _distinct")
        .selectExpr("*", f"array_min(transform(_distinct, x -> struct({others} as others, {order}x as label))) as _best")
        .selectExpr(
            *map(text.name, wide.columns),
            "_best.label as majority",
            f"bigint({n} - _best.others) as top_votes",
            "bigint(_votes) as n_votes",
            f"bigint(size(_distinct) - int(_votes < {n})) as n_labels",
        )
    )


def label_counts(votes: DataFrame) -> DataFrame:
    """The state of a consensus: how often each item got each label, null for failed votes."""
    return votes.groupBy(ITEM, LABEL).agg(F.count(F.lit(1)).alias("n"))


def changed_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """What one model's new votes change: its old rows count -1 and its new ones +1; equal rows cancel out."""
    both = old.select(ITEM, LABEL, F.lit(-1).alias("n")).unionByName(new.select(ITEM, LABEL, F.lit(1).alias("n")))
    return both.groupBy(ITEM, LABEL).agg(F.sum("n").alias("n")).filter("n <> 0")


def merged_counts(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """Counts after changes; states of separate votes merge in the same way."""
    both = counts.select(ITEM, LABEL, "n").unionByName(changes.select(ITEM, LABEL, "n"))
    return both.groupBy(ITEM, LABEL).agg(F.sum("n").alias("n")).filter("n <> 0")


def consensus_of_counts(counts: DataFrame) -> DataFrame:
    """As ``consensus``, ties to the smallest label, from counts in place of votes."""
    valid = F.when(F.col(LABEL).isNotNull(), F.col("n")).otherwise(F.lit(0))
    best = F.min(F.struct(F.when(F.col(LABEL).isNotNull(), -F.col("n")).otherwise(F.lit(0)).alias("n"), F.col(LABEL)))
    return (
        counts.groupBy(ITEM)
        .agg(best.alias("best"), F.max(valid).alias("top_votes"), F.sum(valid).alias("n_votes"), F.count(LABEL).alias("n_labels"))
        .select(ITEM, F.col("best")[LABEL].alias("majority"), "top_votes", "n_votes", "n_labels")
    )


def updated_consensus(cons: DataFrame, counts: DataFrame, changes: DataFrame) -> DataFrame:
    """The consensus after ``changes`` to ``counts``: only items that change are counted anew, votes are not read."""
    touched = changes.select(ITEM).distinct()
    anew = merged_counts(counts.join(touched, ITEM, "left_semi"), changes)
    kept = cons.join(touched, ITEM, "left_anti")
    return kept.select(ITEM, *CONSENSUS).unionByName(consensus_of_counts(anew).select(ITEM, *CONSENSUS))


def judge(votes: DataFrame, tie: str = "label") -> DataFrame:
    """Judged votes from the long table, for any number of voters.

    One shuffle and one sort for all columns. (item, model) is unique, so a
    window holds no more rows than there are voters.
    """
    own = Window.partitionBy(ITEM)
    peers = own.orderBy(LABEL).rangeBetween(Window.currentRow, Window.currentRow)
    order = [F.min(MODEL).over(peers).alias("first")] if tie == "first_model" else []
    ranked = votes.withColumn("n_label", F.count(LABEL).over(peers)).withColumn(
        "_rank", F.struct((-F.col("n_label")).alias("n"), *order, F.col(LABEL))
    )
    return (
        ranked.withColumn("_best", F.min("_rank").over(own))
        .withColumn("n_votes", F.count(LABEL).over(own))
        .select(
            *votes.columns,
            "n_label",
            F.col("_best")[LABEL].alias("majority"),
            (-F.col("_best.n")).alias("top_votes"),
            "n_votes",
        )
    )


def judge_wide(wide: DataFrame, voters: Sequence[str], tie: str = "label") -> DataFrame:
    """Judged votes from the wide table; no shuffle, no join."""
    cells = ", ".join(text.struct(**{MODEL: text.literal(v), LABEL: text.name(v)}) for v in voters)
    rows = with_consensus(wide, voters, tie).selectExpr(
        ITEM,
        "majority",
        "top_votes",
        "n_votes",
        f"array({', '.join(map(text.name, voters))}) as _labels",
        f"explode(array({cells})) as cell",
    )
    same = f"{len(voters)} - size(array_remove(_labels, cell.{LABEL}))"
    n_label = f"bigint(if(cell.{LABEL} is null, 0, {same})) as n_label"
    return rows.selectExpr(ITEM, "cell.*", n_label, "majority", "top_votes", "n_votes")


def label_frequency(votes: DataFrame) -> DataFrame:
    return votes.dropna(subset=[LABEL]).groupBy(MODEL, LABEL).agg(F.count(F.lit(1)).alias("n"))


def top_labels(votes: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent labels over all voters, ties by label."""
    counts = votes.dropna(subset=[LABEL]).groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), LABEL).limit(n)


def label_matrix(votes: DataFrame, voters: Sequence[str]) -> DataFrame:
    """Label by voter counts, 0 where a voter never gave the label; a voter outside the list fails the query."""
    cells = [f"count_if({MODEL} = {text.literal(v)}) as {text.name(v)}" for v in voters]
    return only_listed(votes.dropna(subset=[LABEL]), MODEL, voters).groupBy(LABEL).agg(*map(F.expr, cells))


def diversity(votes: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct labels per voter."""
    distinct = F.approx_count_distinct(LABEL) if approx else F.count_distinct(F.col(LABEL))
    return votes.groupBy(MODEL).agg(distinct.alias("n_labels"))


def top_class_share(votes: DataFrame, listing: DataFrame, restricted: bool = False) -> DataFrame:
    """Most frequent label per voter and its share of all records."""
    return (
        label_frequency(aligned(votes, listing, restricted))
        .groupBy(MODEL)
        .agg(F.min(F.struct(-F.col("n"), F.col(LABEL))).alias("best"), F.count(F.lit(1)).alias("n_labels"))
        .select(
            MODEL,
            "n_labels",
            F.col("best")[LABEL].alias("top_label"),
            (-F.col("best.col1")).alias("top_count"),
        )
        .withColumn("top_share", F.lit(100.0) * F.col("top_count") / record_count(listing))
    )


def agreement_rates(
    cons: DataFrame, listing: DataFrame, strong: int = 7, majority: int = 5, full_min_votes: int = 1
) -> DataFrame:
    """Full, strong and majority agreement in percent of all records, and mean top vote count.

    Full means one distinct label among at least ``full_min_votes`` votes.
    """
    full = (F.col("n_labels") == 1) & (F.col("n_votes") >= full_min_votes)
    counts = aligned(cons, listing).agg(
        F.count_if(full).alias("full"),
        F.count_if(F.col("top_votes") >= strong).alias("strong"),
        F.count_if(F.col("top_votes") >= majority).alias("majority"),
        F.sum("top_votes").alias("votes"),
    ).withColumn("total", record_count(listing))
    percent = [(F.lit(100.0) * F.col(c) / F.col("total")).alias(f"{c}_pct") for c in ("full", "strong", "majority")]
    return counts.select(*percent, (F.col("votes") / F.col("total")).alias("mean_votes"))


def majority_distribution(cons: DataFrame, n: int = 15) -> DataFrame:
    """Records per majority label, the ``n`` largest."""
    counts = cons.filter("n_votes > 0").groupBy("majority").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "majority").limit(n)


def _share(denominator: str | int) -> Column:
    """Share of the majority among the valid votes, or among a given number of voters."""
    if denominator == "valid":
        return F.when(F.col("n_votes") > 0, F.col("top_votes") / F.col("n_votes")).otherwise(F.lit(0.0))
    return F.col("top_votes") / F.lit(float(denominator))


def category_consensus(
    cons: DataFrame, n: int = 15, denominator: str | int = "valid", min_items: int = 0
) -> DataFrame:
    """Mean consensus percent per majority label with at least ``min_items`` records, best ``n``."""
    return (
        cons.filter("n_votes > 0")  # the cheap column: a filter on the majority would compute it twice
        .groupBy("majority")
        .agg((F.avg(_share(denominator)) * 100.0).alias("consensus_pct"), F.count(F.lit(1)).alias("n_items"))
        .filter(F.col("n_items") >= min_items)
        .orderBy(F.desc("consensus_pct"), "majority")
        .limit(n)
    )


def _tally(keyed: DataFrame, key: str, without_vote: object, listing: DataFrame, keys: Sequence = ()) -> DataFrame:
    """Items per key over all records, given keyed items.

    Records that have no row in ``keyed`` count under ``without_vote``: the
    listing adds its size there and every tallied item takes one back. Each of
    ``keys`` appears even with count 0.
    """
    spark = keyed.sparkSession
    typ = keyed.schema[key].dataType
    lost = F.lit(without_vote).cast(typ)
    counts = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    moved = counts.select(
        F.explode(F.array(F.struct(key, "n"), F.struct(lost.alias(key), (-F.col("n")).alias("n")))).alias("c")
    ).select("c.*")
    everyone = listing.agg(F.count(F.lit(1)).alias("n")).select(lost.alias(key), "n")
    empty = spark.createDataFrame([(k, 0) for k in keys], f"{key} {typ.simpleString()}, n bigint")
    total = moved.unionByName(everyone).unionByName(empty).groupBy(key).agg(F.sum("n").alias("n"))
    return total if keys else total.filter("n > 0")


def consensus_histogram(cons: DataFrame, listing: DataFrame) -> DataFrame:
    """Records per number of agreeing voters; 0 for records without a valid vote."""
    return _tally(aligned(cons, listing).select("top_votes"), "top_votes", 0, listing)


def _bin(value: Column, edges: Sequence[float], names: Sequence[str], right: bool) -> Column:
    inside = [value <= edge if right else value < edge for edge in edges]
    return F.coalesce(*[F.when(hit, F.lit(name)) for hit, name in zip(inside, names)])


def consensus_bins(cons: DataFrame, listing: DataFrame) -> DataFrame:
    """Records per consensus share in five bins closed on the left; no vote counts as share 0."""
    names = fixed.CONSENSUS_BINS
    binned = aligned(cons, listing).select(_bin(_share("valid"), fixed.CONSENSUS_EDGES, names, right=False).alias("bin"))
    return _tally(binned, "bin", names[0], listing, names)


def agreement_bins(cons: DataFrame, listing: DataFrame, n_voters: int) -> DataFrame:
    """Records per agreement percent of all voters in three bins closed on the right."""
    names = fixed.AGREEMENT_BINS
    percent = _share(n_voters) * 100.0
    binned = aligned(cons, listing).select(_bin(percent, fixed.AGREEMENT_EDGES, names, right=True).alias("bin"))
    return _tally(binned, "bin", names[0], listing, names)


def unanimity(cons: DataFrame) -> DataFrame:
    """Unanimous (more than one vote), Majority (over half) and Minority records."""
    level = (
        F.when((F.col("top_votes") == F.col("n_votes")) & (F.col("n_votes") > 1), F.lit("Unanimous"))
        .when(F.col("top_votes") * 2 > F.col("n_votes"), F.lit("Majority"))
        .otherwise(F.lit("Minority"))
    )
    counts = cons.filter("n_votes > 0").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    names = [("Unanimous", 0), ("Majority", 0), ("Minority", 0)]
    zero = cons.sparkSession.createDataFrame(names, "level string, n bigint")
    return counts.unionByName(zero).groupBy("level").agg(F.sum("n").alias("n"))


def _share_of_records(judged: DataFrame, hit: Column, listing: DataFrame, name: str, restricted: bool) -> DataFrame:
    counts = aligned(judged, listing, restricted).groupBy(MODEL).agg(F.count_if(hit).alias("n"))
    return counts.select(MODEL, (F.lit(100.0) * F.col("n") / record_count(listing)).alias(name))


def unique_vote(judged: DataFrame, listing: DataFrame, restricted: bool = False) -> DataFrame:
    """Percent of all records where a voter alone gave its label."""
    return _share_of_records(judged, F.col("n_label") == 1, listing, "unique_pct", restricted)


def alignment(judged: DataFrame, listing: DataFrame, restricted: bool = False) -> DataFrame:
    """Percent of all records where a voter gave the majority label."""
    return _share_of_records(judged, F.col(LABEL) == F.col("majority"), listing, "alignment_pct", restricted)


def divergence(judged: DataFrame, min_votes: int = 3) -> DataFrame:
    """Percent of a voter's valid votes that miss the majority, over items with enough votes."""
    counted = F.col(LABEL).isNotNull() & (F.col("n_votes") >= min_votes)
    return (
        judged.groupBy(MODEL)
        .agg(
            F.count_if(counted & (F.col(LABEL) != F.col("majority"))).alias("n_divergent"),
            F.count_if(counted).alias("n_valid"),
        )
        .select(
            MODEL,
            "n_valid",
            F.when(F.col("n_valid") > 0, F.lit(100.0) * F.col("n_divergent") / F.col("n_valid"))
            .otherwise(F.lit(0.0))
            .alias("divergence_pct"),
        )
    )


def family_means(rates: DataFrame, value: str, family: Column, families: Sequence[str]) -> DataFrame:
    """Mean of a rate per family; 0.0 for a listed family without a row, others left out."""
    rows = rates.select(family.alias("family"), F.col(value).alias("rate")).filter(F.col("family").isin(*families))
    empty = rates.sparkSession.createDataFrame([(f, None) for f in families], "family string, rate double")
    return (
        rows.unionByName(empty)
        .groupBy("family")
        .agg(F.coalesce(F.avg("rate"), F.lit(0.0)).alias(value))
    )


def family_alignment(
    judged: DataFrame, listing: DataFrame, family_of: Mapping[str, str], families: Sequence[str], restricted: bool = False
) -> DataFrame:
    """Mean alignment of the voters of each family."""
    rates = alignment(judged, listing, restricted)
    return family_means(rates, "alignment_pct", lookup(F.col(MODEL), family_of), families)


def error_rates(votes: DataFrame, listing: DataFrame, restricted: bool = False) -> DataFrame:
    """Valid and failed records per voter; an absent or null vote is a failure."""
    return (
        aligned(votes, listing, restricted)
        .groupBy(MODEL)
        .agg(F.count(LABEL).alias("n_valid"))
        .withColumn("total", record_count(listing))
        .select(
            MODEL,
            "n_valid",
            (F.col("total") - F.col("n_valid")).alias("n_error"),
            (F.lit(100.0) * (F.col("total") - F.col("n_valid")) / F.col("total")).alias("error_pct"),
        )
    )
