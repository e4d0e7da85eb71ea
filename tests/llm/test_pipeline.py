"""The pipeline's stages against plain versions, and the library without the package."""

import collections
import os
import random
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from concord.llm import line_crf, mixing, secrets
from concord.llm.common import words, written
from llm_cases import make_docs, odd, small_docs  # noqa: F401
from test_corpus_operators import check_packing, encoded, plain_near  # noqa: F401

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark, make_docs, small_docs, odd):
    rng = random.Random(1)
    source = lambda: rng.choice(["a", "a", "a", "b", "é", None])
    rows = [(i, t, source()) for i, t in small_docs] + [(1000 + i, t, source()) for i, t in enumerate(odd)]
    long = " ".join(f"word{i}" for i in range(80))
    rows += [(2000 + i, f"{long} password=secret{i}secret{i} end.", source()) for i in range(3)]
    rows += [(None, long + " none.", "a"), (5, long + " and again.", "b")]
    return written(make_docs(rows))


def names(docs):
    return docs.columns, [f.dataType for f in docs.schema]


def test_quality_stage(spark, docs):
    out = corpus_pipeline.quality(spark, docs, SMALL)
    model = line_crf.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    kept = [r for r in docs.collect() if line_crf.judge(r.text, model, {})[-1]]
    assert names(out) == names(docs) and sorted(map(repr, out.collect())) == sorted(map(repr, kept))


def test_near_duplicate_stage(spark, docs):
    out = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = collections.Counter()
    for doc_id, _, least, _ in plain_near(rows):
        groups[least] += 1
    blank = sum(not words(t) for _, t in rows)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert names(out) == names(docs) and set(got) <= set(rows)
    # a row for each component: each has a smallest id of its own here, also texts without words
    assert len(got) == len({(d, t) for d, t in got}) and sum(not words(t) for _, t in got) == blank
    firsts = {d for d, _, least, kept in plain_near(rows) if kept and d is not None}
    assert {d for d, _ in got if d is not None} == firsts


def test_rows_keep_their_numbers_between_scans(spark, docs, tmp_path, monkeypatch):
    """Files are dealt to other tasks in the later scan, as when an executor comes or goes."""
    rows = written(docs.select("doc_id", "text").filter("doc_id < 1000 and length(text) > 40").limit(40))
    rows.union(rows).repartition(8).write.parquet(str(tmp_path / "d"))
    link, cost = corpus_pipeline.minhash.link_documents, "spark.sql.files.openCostInBytes"
    before = spark.conf.get(cost)

    def linked(*args):
        found = written(link(*args))
        spark.conf.set(cost, "1g")  # a file is a task of its own from here on
        return found

    monkeypatch.setattr(corpus_pipeline.minhash, "link_documents", linked)
    spark.conf.set(cost, "0")
    try:
        given = spark.read.parquet(str(tmp_path / "d"))
        got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, given, SMALL).collect()]
    finally:
        spark.conf.set(cost, before)
    kept = {d for d, _, _, kept in plain_near([tuple(r) for r in given.collect()]) if kept}
    assert sorted(got) == sorted(kept)


def test_secret_stage(spark, docs):
    out = corpus_pipeline.secret_scan(spark, docs, SMALL)
    hits = secrets.automaton()
    want = [(r.doc_id, secrets.redacted(r.text, secrets.find_secrets(r.text, hits)), r.source) for r in docs.collect()]
    assert names(out) == names(docs)
    rows = out.collect()
    assert sorted(map(repr, [(r.doc_id, r.text, r.source) for r in rows])) == sorted(map(repr, want))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert not any("secret1secret1" in (r.text or "") for r in rows)


def test_mixing_stage(spark, docs):
    out = corpus_pipeline.mix(spark, docs, SMALL)
    assert names(out) == names(docs)
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r.source] += r.taken
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id, r.source].append(words(r.text))
    given = collections.Counter()
    for r in out.collect():
        own = words(r.text)
        assert r.n_chars == len(r.text) and any(own == t[: len(own)] for t in texts[r.doc_id, r.source])
        given[r.doc_id, r.source] += len(own)
    assert given == +taken


def test_packing_stage(spark, docs, encoded):
    rows = [(r.doc_id, r.text) for r in docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    only = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.pack(spark, only, SMALL).collect()
    assert check_packing(rows, got, encoded("byte_bpe_50k.json", [t for _, t in rows])) == 0


def test_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "secret scan", "mixing", "packing"]
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    total = {(r.doc_id, r.doc_tokens) for r in pieces}
    assert pieces and total and max(r.offset + r.length for r in pieces) <= 2048


def test_stages_on_an_empty_table(spark, docs):
    empty = written(docs.limit(0))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_partial_text_is_its_first_words(spark, make_docs):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(100)), "a") for i in range(5)]
    rows += [(10 + i, " ".join(f"v{i}_{j}" for j in range(40)), "b") for i in range(2)]
    out = corpus_pipeline.mix(spark, written(make_docs(rows)), SMALL).select(F.size(F.split("text", " ")).alias("n"), "source")
    used = {r.source: r.n for r in out.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    assert used["b"] == 240 and abs(used["a"] - 340) <= mixing.BLOCK  # b stops at three times its size


def test_library_without_the_package(tmp_path):
    """Entry and queries load when package, its tests and the pipeline are gone."""
    root = tmp_path / "repo"
    leave = lambda d, files: [f for f in files if f in ("llm", "corpus_pipeline.py", ".git", "__pycache__")]
    shutil.copytree(ROOT, root, ignore=leave)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"
    env = os.environ | {"PYTHONPATH": str(root)}
    said = subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, check=True)
    from concord.plans.all_queries import QUERIES

    assert said.stdout.split()[-3:] == [str(len(QUERIES)), "False", "False"]
