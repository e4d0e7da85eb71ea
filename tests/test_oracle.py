"""Every registered query against its SQL on the smallest tables."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry
from conftest import SMALL

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, db, name):
    verdict = compare(QUERIES[name](spark, SMALL), db, ORACLE[name])
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["majority", "consensus_pct", "n_items"]
    assert df.count() > 0
