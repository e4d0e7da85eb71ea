"""User scorers, embeddings, neighbours and the probe."""

import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from concord.operators import cells, neighbours, probe, scoring
from conftest import as_dict, as_set

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def upper_scorer():
    def score(batch):
        if (batch["text"] == "bad").any():
            raise ValueError("bad record")
        return [t.upper() for t in batch["text"]]

    return score


def broken_factory():
    raise OSError("no weights")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, "bad" if i % 10 == 3 else f"t{i}") for i in range(100)], "item_id bigint, text string")


def test_failed_records_keep_their_rows(texts):
    got = as_dict(scoring.score_partitions(texts, upper_scorer, ["text"], num_partitions=3), "item_id", "prediction")
    assert len(got) == 100
    assert all(got[i] == ("Error_Processing" if i % 10 == 3 else f"T{i}") for i in got)


def test_failed_factory_marks_every_row(texts):
    got = scoring.score_partitions(texts, broken_factory, ["text"], latency=True)
    assert as_set(got.select("prediction", "latency_s").distinct()) == {("Error_Model_Load", 0.0)}
    assert got.count() == 100


def test_latency_is_zero_only_for_failures(texts):
    got = scoring.score_partitions(texts, upper_scorer, ["text"], latency=True)
    assert got.schema["latency_s"].dataType.simpleString() == "float"
    assert all((r.latency_s == 0.0) == (r.prediction == "Error_Processing") for r in got.collect())


def test_wrong_result_count_is_a_failure(texts):
    def factory():
        return lambda batch: ["x", "y"]

    got = scoring.score_partitions(texts, factory, ["text"])
    assert as_set(got.select("prediction").distinct()) == {("Error_Processing",)}


def letters():
    def vectors(texts):
        if "bad" in list(texts):
            raise ValueError
        return [[float(len(text)), 4.0] for text in texts]

    return vectors


def test_one_bad_record_costs_few_calls():
    """A bad record among 10,000 is found by halving, not by scoring each record alone."""
    calls = []

    def score(batch):
        calls.append(len(batch))
        if (batch["text"] == "bad").any():
            raise ValueError
        return list(batch["text"])

    frame = pd.DataFrame({"text": ["bad" if i == 4321 else "t" for i in range(10_000)]})
    labels, seconds = scoring._halving(score, frame, "failed")
    assert labels == ["failed" if i == 4321 else "t" for i in range(10_000)] and len(calls) < 40
    assert [s == 0.0 for s in seconds] == [x == "failed" for x in labels]


def test_batches_are_bounded(texts):
    def factory():
        def score(batch):
            assert len(batch) <= 7
            return [str(len(batch))] * len(batch)

        return score

    got = scoring.score_partitions(texts, factory, ["text"], batch_size=7)
    assert "Error_Processing" not in as_dict(got, "item_id", "prediction").values()


def test_embedders_for_one_record(texts):
    one = scoring.each_record(lambda: lambda text: [1.0 / (text != "bad"), 2.0])
    df = texts.select("item_id", scoring.embed_column(one)(F.col("text")).alias("v"))
    got = as_dict(df, "item_id", "v")
    assert got[3] is None and got[12] == [1.0, 2.0]


def test_embed_column_gives_null(texts):
    df = texts.select("item_id", scoring.embed_column(letters)(F.col("text")).alias("v"))
    got = as_dict(df, "item_id", "v")
    assert got[3] is None and got[12] == [3.0, 4.0] and len(got) == 100


def test_embed_partitions_drops_bad(texts):
    got = as_dict(scoring.embed_partitions(texts, letters, "item_id", "text"), "item_id", "embedding")
    assert len(got) == 90 and got[12] == pytest.approx([0.6, 0.8])


def grid_factory(model):
    if model == "broken":
        raise RuntimeError("no weights")

    def score(batch):
        if model == "picky" and (batch["x"] == 5).any():
            raise ValueError("five")
        return ["even" if x % 2 == 0 else "odd" for x in batch["x"]]

    return score


def test_evaluate_grid(spark):
    truth = F.when(F.col("x") < 3, F.lit("even")).otherwise(F.when(F.col("x") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")))
    models = F.explode(F.array(*[F.lit(m) for m in ("good", "broken", "picky")])).alias("model")
    records = spark.range(10).select(F.lit("d").alias("dataset"), F.col("id").alias("x"), models).withColumn("truth", truth)
    got = {r.model: r for r in scoring.evaluate_grid(records.repartition(4), grid_factory, ["x"]).collect()}
    good = got["good"]
    assert (good.num_classes, good.test_samples, good.accuracy, good.error) == (2, 10, 90.0, None)
    # even: precision 1, recall 5/6; odd: precision 4/5, recall 1
    assert good.macro_precision == pytest.approx(90.0) and good.macro_recall == pytest.approx(100 * (5 / 6 + 1) / 2)
    assert got["broken"].error == "RuntimeError: no weights" and got["broken"].accuracy is None
    assert got["picky"].error == "ValueError: five" and got["picky"].test_samples is None


@pytest.mark.parametrize("models", [["good"], ["broken"], ["good", "also good"], ["broken", "good"]])
def test_evaluate_grid_with_and_without_failures(spark, models):
    records = spark.range(12).select(
        F.lit("d").alias("dataset"),
        F.col("id").alias("x"),
        F.explode(F.array(*[F.lit(m) for m in models])).alias("model"),
        F.when(F.col("id") == 11, F.lit(None)).otherwise(F.when(F.col("id") % 2 == 0, F.lit("even")).otherwise(F.lit("odd"))).alias("truth"),
    )
    got = {r.model: r for r in scoring.evaluate_grid(records, grid_factory, ["x"]).collect()}
    assert set(got) == set(models)
    for model, r in got.items():
        if model == "broken":
            assert (r.error, r.num_classes) == ("RuntimeError: no weights", None)
        else:  # a null truth is no class, and its record does not count
            assert (r.error, r.num_classes, r.test_samples, r.accuracy) == (None, 2, 11, 100.0)


def test_evaluate_grid_loads_once_and_holds_one(spark, tmp_path):
    """A failing factory is called once per task and model, whatever the batches and datasets."""
    log = str(tmp_path)

    def factory(model):
        with open(f"{log}/{model}-{os.getpid()}", "a") as f:
            f.write("x")
        if model == "broken":
            raise RuntimeError("no weights")
        return lambda batch: ["a"] * len(batch)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        records = spark.range(2000).select(
            F.concat(F.lit("d"), F.col("id") % 3).alias("dataset"),
            F.when(F.col("id") % 2 == 0, F.lit("fine")).otherwise(F.lit("broken")).alias("model"),
            F.lit("a").alias("truth"),
        )
        rows = scoring.evaluate_grid(records.coalesce(1), factory, [], spread=1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 6
    assert sum(os.path.getsize(f"{log}/{f}") for f in os.listdir(log)) == 2


def vectors_of(spark, matrix, labels=None):
    rows = [(i, [float(x) for x in v], int(labels[i]) if labels is not None else 0) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    matrix = rng.normal(size=(400, 8)).astype("float32")
    matrix[50:150] = matrix[0]  # a third of the rows are copies
    vecs = vectors_of(spark, matrix).repartition(5)
    queries = vecs.filter("vec_id in (0, 7, 399)").select(F.col("vec_id").alias("query_id"), "embedding")
    got = neighbours.nearest(vecs, queries, k=5).collect()
    for q in (0, 7, 399):
        d = ((matrix.astype("float64") - matrix[q].astype("float64")) ** 2).sum(axis=1)
        want = np.lexsort((np.arange(400), d.round(9)))[:5]
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in rows] == list(want)
        assert [r.distance_sq for r in rows] == pytest.approx(list(d[want]))
        assert rows[0].distance == 0.0


def brute(matrix, queries, k):
    """The k nearest rows of each query, equal distances by place."""
    x = np.asarray(matrix, dtype="float32").astype("float64")
    out = {}
    for q in queries:
        d = ((x - x[q]) ** 2).sum(axis=1)
        out[q] = [(int(i), float(d[i])) for i in np.lexsort((np.arange(len(x)), d.round(9)))[:k]]
    return out


def found_by(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.distance_sq))
    return got


def same(got, want):
    assert got.keys() == want.keys()
    for q, rows in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in rows]
        assert [d for _, d in got[q]] == pytest.approx([d for _, d in rows], abs=1e-9)


def blobs(n, centres, dims, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    return 5 * rng.normal(size=(centres, dims))[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dims))


def queries_of(vecs, condition):
    return vecs.filter(condition).select(F.col("vec_id").alias("query_id"), "embedding")


@pytest.mark.parametrize("shape", ["random", "blobs", "copies", "grid"])
def test_search_through_pivots_is_exact(spark, monkeypatch, shape):
    monkeypatch.setattr(cells, "CELL", 40)
    monkeypatch.setattr(neighbours, "CELL", 40)
    rng = np.random.default_rng(5)
    matrix = {
        "random": rng.normal(size=(900, 8)),
        "blobs": blobs(900, 12, 6, 5),
        "copies": np.where(rng.uniform(size=(900, 1)) < 0.4, 1.0, rng.normal(size=(900, 5))),
        "grid": np.stack([np.arange(900) % 30, np.arange(900) // 30], axis=1).astype(float),  # many equal distances
    }[shape]
    vecs = vectors_of(spark, matrix).repartition(4)
    same(found_by(neighbours.nearest_many(vecs, queries_of(vecs, "vec_id % 9 = 0"), 6, pivots=20)), brute(matrix, range(0, 900, 9), 6))


def test_pivots_rule_out_most_pairs_of_clustered_vectors(spark):
    matrix = blobs(3000, 40, 8, 6)
    vecs = vectors_of(spark, matrix)
    index = neighbours.PivotIndex(neighbours._given(vecs, "vec_id", "embedding"))
    named = neighbours._named(neighbours._asked(queries_of(vecs, "vec_id % 10 = 0"), ["query_id"], "embedding"))
    first = index.first_visits(named, 5)
    later = index.later_visits(named, index.met(first, 5), 5)
    compared = sum(index.sizes[r.g] * r["count"] for r in first.union(later).groupBy("g").count().collect())
    assert index.sizes.sum() == 3000 and compared < 0.1 * 300 * 3000


def test_many_queries_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FEW", 2)
    matrix = np.random.default_rng(8).normal(size=(50, 3))
    vecs = vectors_of(spark, matrix)
    one = queries_of(vecs, "vec_id = 7")
    got = neighbours.nearest(vecs, one.union(one).union(one).union(queries_of(vecs, "vec_id = 8")), 4)
    counts = as_dict(got.groupBy("query_id", "rank").count().select(F.struct("query_id", "rank").alias("q"), "count"), "q", "count")
    assert {tuple(q): n for q, n in counts.items()} == {(q, r): 3 if q == 7 else 1 for q in (7, 8) for r in range(1, 5)}


def test_search_of_and_for_nothing(spark, monkeypatch):
    vecs = vectors_of(spark, np.eye(3))
    for few in (256, 0):  # as a scan and through pivots
        monkeypatch.setattr(neighbours, "FEW", few)
        assert neighbours.nearest(vecs, queries_of(vecs, "false")).count() == 0
        assert neighbours.nearest(vecs.filter("false"), queries_of(vecs, "true")).count() == 0
        assert neighbours.nearest(vecs, queries_of(vecs, "true"), k=9).count() == 9
    assert neighbours.nearest_lsh(vecs.filter("false"), queries_of(vecs, "true")).count() == 0
    assert neighbours.nearest_lsh(vecs, queries_of(vecs, "false")).count() == 0


def test_null_vectors_and_keys_take_no_part(spark):
    rows = [(1, [0.0, 1.0]), (2, None), (None, [0.0, 1.0]), (3, [1.0, 1.0])]
    vecs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    queries = vecs.select(F.col("vec_id").alias("query_id"), "embedding")
    for search in (neighbours.nearest, neighbours.nearest_many, neighbours.nearest_lsh):
        got = [(r.query_id, r["rank"], r.vec_id) for r in search(vecs, queries, 2).collect()]
        assert sorted(got, key=repr) == sorted([(1, 1, 1), (1, 2, 3), (None, 1, 1), (None, 2, 3), (3, 1, 3), (3, 2, 1)], key=repr)


@pytest.mark.parametrize("shape", ["random", "blobs"])
def test_hashed_search_of_many_queries(spark, shape):
    matrix = np.random.default_rng(3).normal(size=(1500, 16)) if shape == "random" else blobs(1500, 30, 16, 3)
    vecs = vectors_of(spark, matrix)
    got = found_by(neighbours.nearest_lsh(vecs, queries_of(vecs, "vec_id % 5 = 0"), k=5))
    want = brute(matrix, range(0, 1500, 5), 5)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in rows}) for q, rows in want.items())
    assert hits >= 0.9 * 5 * 300
    x = matrix.astype("float32").astype("float64")
    for q, rows in got.items():
        assert rows[0][0] == q and len({i for i, _ in rows}) == len(rows)
        assert all(d == pytest.approx(((x[i] - x[q]) ** 2).sum(), abs=1e-9) for i, d in rows)


def test_hashed_search_splits_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 16)
    matrix = np.where(np.arange(300)[:, None] < 200, 1.0, np.random.default_rng(4).normal(size=(300, 4)))
    vecs = vectors_of(spark, matrix)
    got = found_by(neighbours.nearest_lsh(vecs, queries_of(vecs, "vec_id in (5, 250)"), k=7))
    assert got[5] == [(i, 0.0) for i in range(7)] and got[250][0] == (250, 0.0)


def test_probes_begin_at_home(spark):
    import pandas as pd

    hashing = neighbours.Hashing(tables=3, width=2, reach=1, seed=1)
    v, spread = pd.Series(list(np.random.default_rng(0).normal(size=(300, 4)))), pd.Series([1.0] * 300)
    buckets, probes = hashing.buckets().func(v, spread), hashing.probes().func(v, spread)
    assert all(set(b) == set(p[:3]) and len(set(p)) == 27 for b, p in zip(buckets, probes))


def test_nearest_with_many_queries_and_text_keys(spark):
    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(1300, 4)).astype("float32")
    vecs = vectors_of(spark, matrix).withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id")))
    queries = vecs.select(F.col("vec_id").alias("query_id"), "embedding")
    got = neighbours.nearest(vecs, queries, k=1).collect()
    assert len(got) == 1300 and all(r.query_id == r.vec_id and r.distance == 0.0 for r in got)


def test_more_classes_than_a_block(spark):
    """Ties between blocks of centres go to the smaller label as well."""
    points = np.arange(1500, dtype="float64")[:, None]
    vecs = vectors_of(spark, points, np.arange(1500))
    centres = vecs.select("label", "embedding").union(
        vecs.select((F.col("label") + 2000).alias("label"), "embedding")
    )
    got = neighbours.nearest_centroid(vecs, centres).collect()
    assert len(got) == 1500 and all(r.prediction == r.truth and r.distance_sq == 0.0 for r in got)


@pytest.mark.parametrize("n", [3, 20_000])
def test_classifier_with_many_classes(spark, n):
    centres = blobs(n, 100, 6, 9, spread=0.5)
    vectors = np.random.default_rng(10).normal(scale=4, size=(300, 6))
    c = spark.createDataFrame([(i, v) for i, v in enumerate(centres.tolist())], "label int, embedding array<double>")
    vecs = vectors_of(spark, vectors)
    got = as_dict(neighbours.nearest_centroid(vecs, c), "vec_id", "prediction")
    x = vectors.astype("float32").astype("float64")
    assert [got[i] for i in range(300)] == [int(((centres - v) ** 2).sum(axis=1).round(9).argmin()) for v in x]


def test_far_centres_are_not_compared():
    centres = blobs(20_000, 200, 8, 11)
    index = neighbours.Centres(centres)
    x = blobs(500, 200, 8, 11)
    best, distance = index.nearest(x)
    for i in range(0, 500, 10):
        d = ((centres - x[i]) ** 2).sum(axis=1)
        assert best[i] == d.round(9).argmin() and distance[i] == pytest.approx(d.min())
    assert index.compared < 0.2 * 500 * 20_000


def test_more_centres_than_go_to_the_tasks(spark, monkeypatch):
    matrix, labels = clusters()
    vecs = vectors_of(spark, matrix, labels)
    rows = [(None, [0.0, 0.0, 0.0, 1.0], None), (7, None, 1)]
    vecs = vecs.union(spark.createDataFrame(rows, vecs.schema))
    centres = neighbours.centroids(vecs.filter("label is not null and embedding is not null"))
    want = as_set(neighbours.nearest_centroid(vecs, centres))
    monkeypatch.setattr(neighbours, "CENTRE_BYTES", 1)
    assert as_set(neighbours.nearest_centroid(vecs, centres)) == want
    monkeypatch.setattr(neighbours, "FEW", 1)
    assert as_set(neighbours.nearest_centroid(vecs, centres)) == want
    assert len(want) == 601


def clusters(n=600, classes=3):
    rng = np.random.default_rng(2)
    labels = rng.integers(0, classes, n)
    return rng.normal(size=(n, 4)) + 6 * np.eye(4)[labels], labels


def test_centroid_classifier(spark):
    matrix, labels = clusters()
    vecs = vectors_of(spark, matrix, labels)
    centres = neighbours.centroids(vecs)
    for row in centres.collect():
        assert row.embedding == pytest.approx(list(matrix.astype("float32")[labels == row.label].mean(axis=0)), abs=1e-5)
    got = neighbours.nearest_centroid(vecs, centres).collect()
    assert len(got) == 600 and np.mean([r.truth == r.prediction for r in got]) > 0.97


def test_linear_probe_learns_separable_classes(spark):
    matrix, labels = clusters()
    tested = probe.linear_probe(vectors_of(spark, matrix, labels))
    scores = probe.probe_scores(tested).first()
    assert scores.test_samples == 120
    assert scores.accuracy > 95 and scores.macro_f1 > 95


def test_probe_takes_text_classes_and_sparse_ids(spark):
    matrix, labels = clusters()
    vecs = vectors_of(spark, matrix, labels)
    for label in (F.concat(F.lit("c"), F.col("label")), F.col("label") * 1_000_000):
        tested = probe.linear_probe(vecs.withColumn("label", label))
        rows = tested.collect()
        assert len(rows) == 120 and np.mean([r.truth == r.prediction for r in rows]) > 0.95


def test_training_steps_match_a_second_computation(spark):
    """The same batches in numpy, step by step: accuracy by epoch and weights."""
    matrix, labels = clusters(400)
    vecs = vectors_of(spark, matrix, labels).withColumn("label", F.concat(F.lit("c"), F.col("label"))).repartition(20)
    trained = probe.train(vecs, epochs=3, batches=5, rate=0.05, seed=3)
    x = np.hstack([matrix.astype("float32").astype("float64"), np.ones((400, 1))])
    weights = first = second = np.zeros((3, 5))
    history, step = [], 0
    for epoch in range(3):
        of = F.pmod(F.xxhash64(F.lit(3), F.lit(epoch), "vec_id"), F.lit(5))
        batch = as_dict(vecs.select("vec_id", of.alias("b")), "vec_id", "b")
        hits = 0
        for b in range(5):
            own = [i for i in range(400) if batch[i] == b]
            z = x[own] @ weights.T
            hits += (z.argmax(axis=1) == labels[own]).sum()
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True) - np.eye(3)[labels[own]]
            gradient, step = p.T @ x[own] / len(own), step + 1
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
            weights = weights - 0.05 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        history.append(100 * hits / 400)
    assert trained.history == pytest.approx(history) and trained.weights == pytest.approx(weights)
    assert [tuple(r) for r in trained.epochs().collect()] == [(i, pytest.approx(a)) for i, a in enumerate(history, 1)]
    assert history[2] > 95


def test_probe_of_nothing(spark):
    vecs = vectors_of(spark, np.eye(2)).filter("false")
    assert probe.train(vecs).history == [] and probe.linear_probe(vecs).count() == 0
