"""The vote table: one row per (item, model), long or wide.

Long is the canonical form: ``item_id, model, prediction, latency_s`` with at
most one row per (item, model). Wide has one row per item and one column per
voter; it needs the voter list up front, which keeps the plan static.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import fixed_values as fixed
from concord.functions import text

ITEM, MODEL, LABEL = "item_id", "model", "prediction"
VALUES = {LABEL: "", "latency_s": "_time"}


def only_listed(rows: DataFrame, column: str, listed: Sequence[object]) -> DataFrame:
    """``rows`` themselves; a key outside the list fails the query by name instead of vanishing."""
    key, names = text.name(column), ", ".join(map(text.literal, listed))
    unknown = f"raise_error('not in the given list of {column.strip('_')}s: ' || coalesce(string({key}), 'null'))"
    return rows.filter(f"case when {key} in ({names}) then true else {unknown} end")


def aligned(votes: DataFrame, listing: DataFrame, restricted: bool = False) -> DataFrame:
    """Votes, consensus or wide rows of listed records; both sides are, or get, partitioned by item.

    ``restricted`` rows are of listed records alone already. Long rows are sorted for
    the join, several an item, so align the wide table before it is made long.
    """
    if restricted:
        return votes
    return votes.join(listing.select(ITEM), ITEM, "left_semi")


def collapse(
    rows: DataFrame,
    item: Column,
    voter: Column,
    voters: Mapping[object, str],
    measures: Mapping[str, Column],
) -> DataFrame:
    """Raw rows straight to the wide table: the minimum of each measure per item and voter.

    One shuffle on the item, after map-side combining, so a hot item or
    repeated rows shrink before they move. ``voters`` maps voter key to name,
    ``measures`` column suffix to expression. A voter outside the list fails
    the query instead of vanishing.
    """
    # Measures are computed once per row here, not once per voter in the aggregation.
    cells = {f"_measure{i}": value for i, value in enumerate(measures.values())}
    prepared = rows.select(item.alias(ITEM), voter.alias("_voter"), *[v.alias(c) for c, v in cells.items()])
    minima = [
        f"min(case when _voter = {text.literal(key)} then {cell} end) as {text.name(name + suffix)}"
        for suffix, cell in zip(measures, cells)
        for key, name in voters.items()
    ]
    return only_listed(prepared, "_voter", list(voters)).groupBy(ITEM).agg(*map(F.expr, minima))


def lengthen(wide: DataFrame, voters: Sequence[str], values: Mapping[str, str] = VALUES) -> DataFrame:
    """Wide to long. ``explode`` keeps the partitioning by item, unlike ``unpivot``,
    so later per-item work needs no second shuffle."""
    cells = [
        text.struct(**{MODEL: text.literal(v)}, **{value: text.name(v + suffix) for value, suffix in values.items()})
        for v in voters
    ]
    present = " or ".join(f"cell.{text.name(value)} is not null" for value in values)
    rows = wide.selectExpr(text.name(ITEM), f"explode(array({', '.join(cells)})) as cell")
    return rows.filter(present).select(ITEM, "cell.*")


def unpivot(wide: DataFrame, voters: Sequence[str], id_column: str = ITEM) -> DataFrame:
    """Melt of the prediction columns alone; every cell gives a row, null or not."""
    return wide.unpivot(id_column, list(voters), MODEL, LABEL)


def widen(votes: DataFrame, voters: Sequence[str], values: Mapping[str, str] = VALUES) -> DataFrame:
    """Long to wide, one shuffle on the item. A voter outside the list fails the query."""
    cells = [
        f"max(case when {MODEL} = {text.literal(v)} then {text.name(value)} end) as {text.name(v + suffix)}"
        for value, suffix in values.items()
        for v in voters
    ]
    return only_listed(votes, MODEL, voters).groupBy(ITEM).agg(*map(F.expr, cells))


def map_cells(wide: DataFrame, voters: Sequence[str], expression: str) -> DataFrame:
    """The wide table with ``expression``, in which ``{}`` stands for the cell, applied to every voter."""
    cells = {v: f"{expression.replace('{}', text.name(v))} as {text.name(v)}" for v in voters}
    return wide.selectExpr(*[cells.get(c, text.name(c)) for c in wide.columns])


def clean(wide: DataFrame, voters: Sequence[str], mark: str = fixed.ERROR_MARK) -> DataFrame:
    """The wide table with every failed prediction set to null."""
    return map_cells(wide, voters, f"case when not contains({{}}, {text.literal(mark)}) then {{}} end")


def discover_voters(votes: DataFrame) -> list[str]:
    """Sorted voter names, for the operators that need the list; costs a job and brings one name per voter."""
    return [row[0] for row in votes.select(MODEL).distinct().orderBy(MODEL).collect()]


def live_votes(votes: DataFrame) -> DataFrame:
    """Votes of the voters that have at least one valid prediction.

    The voter names come as one scalar list, so the votes are not shuffled on
    the few, large voter keys.
    """
    alive = votes.groupBy(MODEL).agg(F.count(LABEL).alias("n")).filter("n > 0").agg(F.collect_set(MODEL).alias("m"))
    return votes.filter(F.array_contains(alive.scalar(), F.col(MODEL)))


def select_like(df: DataFrame, *keep: str, suffix: str = "", contains: str = "", drop_suffix: str = "") -> DataFrame:
    """The ``keep`` columns plus those whose name fits the patterns."""
    names = [
        c
        for c in df.columns
        if c not in keep
        and c.endswith(suffix)
        and contains in c
        and not (drop_suffix and c.endswith(drop_suffix))
    ]
    return df.select(*keep, *names)


def strip_names(df: DataFrame, suffix: str = "") -> DataFrame:
    """Column names without surrounding blanks and without ``suffix``."""
    return df.withColumnsRenamed({c: c.strip().removesuffix(suffix) for c in df.columns})
