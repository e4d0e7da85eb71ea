import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from concord.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, shuffle_partitions=4, memory="6g")
    yield session


def votes_of(spark, table):
    """Long votes from {item: {model: label}}; a None label is a failed vote."""
    rows = [(item, model, label) for item, row in table.items() for model, label in row.items()]
    return spark.createDataFrame(rows, "item_id bigint, model string, prediction string")


def wide_of(spark, table, voters):
    rows = [(item, *[row.get(v) for v in voters]) for item, row in table.items()]
    return spark.createDataFrame(rows, "item_id bigint, " + ", ".join(f"{v} string" for v in voters))


def records_of(spark, items):
    return spark.createDataFrame([(i,) for i in items], "item_id bigint")


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def as_set(df):
    return {tuple(r) for r in df.collect()}
