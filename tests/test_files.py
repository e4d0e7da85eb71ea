"""Sources and sinks in temporary folders."""

import os

import pytest
from pyspark.sql import functions as F

from concord.operators import scoring
from concord.sinks import writers
from concord.sources import files, tables
from conftest import as_set, records_of, votes_of


def tree(root, names):
    for name in names:
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(name.encode())


def test_read_files(spark, tmp_path):
    tree(tmp_path, ["cat/a.jpg", "cat/deep/b.jpg", "dog/c.JPG", "dog/d.txt"])
    found = files.read_files(spark, str(tmp_path), "*.jpg")
    assert {os.path.basename(r.path): bytes(r.content) for r in found.collect()} == {
        "a.jpg": b"cat/a.jpg",
        "b.jpg": b"cat/deep/b.jpg",
    }
    listed = files.list_files(spark, str(tmp_path))
    assert listed.columns == ["path"] and listed.count() == 4
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    assert files.with_extension(listed, "path", [".jpg"]).count() == 3


def test_folder_labels(spark, tmp_path):
    tree(tmp_path, ["dog/1.jpg", "cat/sub/2.jpg", "bee/3.jpg", "dog/4.jpg", "stray.jpg"])
    listed = files.list_files(spark, str(tmp_path))
    local = F.regexp_replace("path", "^file:/*", "/")
    got = files.with_folder_label(listed, local, str(tmp_path))
    assert as_set(got.select("label", "class_index")) == {("bee", 0), ("cat", 1), ("dog", 2)}
    assert got.count() == 4


def test_csv_round_trip_and_append(spark, tmp_path):
    path = str(tmp_path / "runs")
    first = tables.literal_rows(spark, [("m1", 1.5), ("m2", None)], "model string, x double")
    writers.write_csv(first, path)
    assert as_set(tables.read_csv(spark, path, "model string, x double")) == {("m1", 1.5), ("m2", None)}
    writers.append_runs(tables.literal_rows(spark, {"m3": 2.5}, "model string, x double"), path)
    inferred = tables.read_csv(spark, path)
    assert dict(inferred.dtypes) == {"model": "string", "x": "double"}
    assert as_set(inferred) == {("m1", 1.5), ("m2", None), ("m3", 2.5)}
    writers.write_csv(first, path)
    assert tables.read_csv(spark, path).count() == 2


def test_parquet_overwrite(spark, tmp_path):
    path = str(tmp_path / "vectors")
    df = spark.createDataFrame([("a", [1.0, 2.0])], "path string, embedding array<float>")
    writers.write_parquet(df, path)
    assert as_set(writers.write_parquet(df, path).select("path")) == {("a",)}
    assert tables.read_parquet(spark, path).schema["embedding"].dataType.simpleString() == "array<float>"


def test_upsert_touches_one_model(spark, tmp_path):
    path = str(tmp_path / "predictions")
    for model, label in (("m1", "a"), ("m2", "b")):
        writers.upsert_predictions(votes_of(spark, {1: {model: label}, 2: {model: label}}).drop("model"), model, path)
    before = sorted(os.listdir(f"{path}/model=m1"))
    writers.upsert_predictions(votes_of(spark, {2: {"m2": "c"}, 9: {"m2": "c"}}).drop("model"), "m2", path)
    assert sorted(os.listdir(f"{path}/model=m1")) == before
    got = writers.read_predictions(spark, path, records_of(spark, [1, 2, 3]))
    assert as_set(got.select("item_id", "model", "prediction")) == {
        (1, "m1", "a"),
        (2, "m1", "a"),
        (2, "m2", "c"),
        (3, None, None),
    }


def test_table_set_and_lines(spark, tmp_path):
    df = spark.createDataFrame([("a & 1",)], "line string")
    writers.write_tables({"one": df, "two": df}, str(tmp_path / "set"))
    assert tables.read_csv(spark, str(tmp_path / "set" / "two")).first()["line"] == "a & 1"
    writers.write_lines(df, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).first()["value"] == "a & 1"


def test_upsert_with_an_empty_result(spark, tmp_path):
    """Stale predictions go even if the model now has none; odd model names survive."""
    path = str(tmp_path / "predictions")
    for model in ("m1", "org/model:v1=x é"):
        rows = spark.createDataFrame([(1, "a")], "item_id bigint, prediction string")
        writers.upsert_predictions(rows, model, path)
    assert as_set(spark.read.parquet(path).select("model")) == {("m1",), ("org/model:v1=x é",)}
    writers.upsert_predictions(rows.limit(0), "m1", path)
    assert as_set(spark.read.parquet(path).select("model")) == {("org/model:v1=x é",)}


def failing_rows(spark):
    """Predictions of which the last cannot be made."""

    def label(i):
        if i == 9_999:
            raise ValueError("no label")
        return f"new{i}"

    return spark.range(0, 10_000, 1, 8).select(F.col("id").alias("item_id"), F.udf(label)("id").alias("prediction"))


def test_a_write_that_fails_keeps_the_old_predictions(spark, tmp_path):
    path = str(tmp_path / "predictions")
    for model in ("m1", "m2"):
        writers.upsert_predictions(spark.range(50).select(F.col("id").alias("item_id"), F.lit("old").alias("prediction")), model, path)
    with pytest.raises(Exception, match="no label"):
        writers.upsert_predictions(failing_rows(spark), "m1", path)
    stored = writers.stored_predictions(spark, path)
    assert as_set(stored.groupBy("model", "prediction").count()) == {("m1", "old", 50), ("m2", "old", 50)}
    writers.upsert_predictions(failing_rows(spark).filter("item_id < 10"), "m1", path)
    assert as_set(writers.stored_predictions(spark, path).groupBy("model").count()) == {("m1", 10), ("m2", 50)}


def test_model_names_that_look_like_numbers(spark, tmp_path):
    path = str(tmp_path / "predictions")
    rows = spark.createDataFrame([(1, "a")], "item_id bigint, prediction string")
    for model in ("007", "7", "1e3"):
        writers.upsert_predictions(rows, model, path)
    assert as_set(writers.read_predictions(spark, path, records_of(spark, [1])).select("model")) == {("007",), ("7",), ("1e3",)}
    writers.upsert_predictions(rows.limit(0), "007", path)
    assert as_set(writers.stored_predictions(spark, path).select("model")) == {("7",), ("1e3",)}


def test_files_are_placed_by_size(spark, tmp_path):
    """One file is a thousand times as large as the others: it stands nearly alone, the rest are spread evenly."""
    tree(tmp_path, [f"c/{i:04d}.bin" for i in range(600)])
    for i in range(600):
        with open(tmp_path / "c" / f"{i:04d}.bin", "wb") as f:
            f.write(b"x" * (100_000 if i == 77 else 100))
    sizes = files.list_sizes(spark, str(tmp_path))
    placed = files.placed_by_size(sizes, 8)
    parts = placed.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("length").alias("bytes"), F.count("*").alias("n"), F.max("length").alias("most")).collect()
    assert sum(r.n for r in parts) == 600
    share = 160_000 / 8
    assert all(r.bytes <= 1.2 * share + 100 for r in parts if r.most == 100)
    (large,) = [r for r in parts if r.most == 100_000]
    assert large.bytes <= 100_000 + 1.2 * share
    scans = [line for line in placed._jdf.queryExecution().executedPlan().toString().splitlines() if "binaryFile" in line]
    assert scans and not any("content" in line for line in scans)


def test_empty_files_and_no_files(spark):
    schema = "path string, length long"
    none = files.placed_by_size(spark.createDataFrame([], schema), 4)
    assert none.count() == 0
    empty = files.placed_by_size(spark.createDataFrame([(f"p{i}", None if i % 2 else 0) for i in range(100)], schema), 4)
    counts = [r["count"] for r in empty.groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) == 4 and max(counts) <= 30


def test_scorer_runs_where_files_are_placed(spark):
    rows = spark.createDataFrame([(f"p{i}", 1000 if i == 3 else 1) for i in range(50)], "path string, length long")

    def task():
        from pyspark import TaskContext

        return lambda batch: [str(TaskContext.get().partitionId())] * len(batch)

    got = scoring.score_partitions(files.placed_by_size(rows, 4), task, ["path"], key="path").collect()
    alone = {r.prediction for r in got if r.path == "p3"}
    assert len(got) == 50 and sum(r.prediction in alone for r in got) < 10
