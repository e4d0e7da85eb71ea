"""Fixtures and odd texts shared by the tests of this folder."""

import json

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", row long, size long, label string, spans string, kept boolean, data binary, node long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) with columns whose names operators use themselves."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        if extra:
            full = [(*r, 1, 2, "x", "y", True, b"z", 3) for r in full]
        return spark.createDataFrame(full, DOCS + EXTRA * extra).repartition(3)

    return make


@pytest.fixture(scope="session")
def small_docs():
    path = f"{SMALL}/documents.parquet"
    return duckdb.sql(f"select doc_id, text from read_parquet('{path}') order by doc_id").fetchall()


#: Texts that have broken such code before: empty, blank, long, repeated, other scripts and control characters.
ODD = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "a" * 3000,
    "ab " * 2000,
    "é" * 500,
    "日本語 テキスト " * 50,
    "x\x1cy\x85z w İ ſ K",
    "😀 " * 300,
    "one two three four five",
    "one two three four five",
    json.dumps({"password": "hunter2hunter2", "n": 1}),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
