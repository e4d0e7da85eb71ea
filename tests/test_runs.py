"""Run summaries, timing, energy and metrics."""

import collections
import random
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from concord.operators import metrics, ordering, runs, sampling, timing
from conftest import as_dict, as_set

RUN_SCHEMA = "dataset string, model string, accuracy double, inference_time_s double, throughput double, latency_ms double"
# Published single-machine runs of three image models, two runs each on two labelled datasets.
RUNS = [
    ("Food-101", "MobileNet-V3", 51.51, 211.56, 95.48, 6.78),
    ("Food-101", "ResNet50", 62.08, 2244.8, 9.0, 111.265),
    ("Food-101", "EfficientNet-B0", 54.22, 764.06, 26.44, 39.629),
    ("ImageNet-Mini", "MobileNet-V3", 44.0, 66.0, 105.0, 9.7),
    ("ImageNet-Mini", "ResNet50", 73.0, 746.0, 9.4, 125.0),
    ("ImageNet-Mini", "MobileNet-V3", 45.0, 67.0, 107.0, 9.9),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(RUNS, RUN_SCHEMA)


def test_run_means_and_best(table):
    means = runs.run_means(table, ["accuracy", "throughput", "latency_ms"])
    assert ("ImageNet-Mini", "MobileNet-V3", 44.5, 106.0, 9.8) in as_set(means)
    best = {r.metric: (r.dataset, r.model, r.value) for r in runs.best_by(means, ["accuracy", "throughput"], ["latency_ms"]).collect()}
    assert best == {
        "accuracy": ("ImageNet-Mini", "ResNet50", 73.0),
        "throughput": ("ImageNet-Mini", "MobileNet-V3", 106.0),
        "latency_ms": ("Food-101", "MobileNet-V3", 6.78),
    }


def test_best_by_ignores_missing(spark):
    rows = [("d", "a", None), ("d", "c", 2.0), ("d", "b", 2.0)]
    df = spark.createDataFrame(rows, "dataset string, model string, x double")
    assert runs.best_by(df, ["x"]).first()["model"] == "b"
    assert runs.best_by(df, lowest=["x"]).first()["model"] == "b"


def test_mean_std_of_a_single_run_is_null(table):
    spread = {(r.dataset, r.model): r for r in runs.mean_std(table, ["accuracy"]).collect()}
    assert spread["ImageNet-Mini", "MobileNet-V3"].accuracy_std == pytest.approx(statistics.stdev([44.0, 45.0]))
    assert spread["Food-101", "ResNet50"].accuracy_std is None


def test_pivot_mean_skips_missing(table):
    pivot = {r.model: r for r in runs.metric_pivot(table, "accuracy", ["Food-101", "ImageNet-Mini"], "mean").collect()}
    assert pivot["EfficientNet-B0"]["ImageNet-Mini"] is None and pivot["EfficientNet-B0"]["mean"] == 54.22
    assert pivot["ResNet50"]["mean"] == pytest.approx((62.08 + 73.0) / 2)
    lines = runs.table_rows(runs.metric_pivot(table, "accuracy", ["Food-101", "ImageNet-Mini"], "mean"), ["model"], ["Food-101", "ImageNet-Mini"])
    assert r"EfficientNet-B0 & 54.22 & NaN \\" in {r.line for r in lines.collect()}


def test_published_headlines(spark):
    """Two-run means of published runs give the published mean accuracy, throughput and score."""
    rows = [
        ("Food-101", "ConvNeXt-Tiny", 73.62, 13.06),
        ("ImageNet-Mini", "ConvNeXt-Tiny", 89.65, 13.12),
        ("Food-101", "MobileNet-V3", 51.34, 93.02),
        ("ImageNet-Mini", "MobileNet-V3", 44.37, 105.23),
    ]
    df = spark.createDataFrame(rows, "dataset string, model string, accuracy double, throughput double")
    scores = {r.model: r for r in runs.efficiency_score(df).collect()}
    assert scores["ConvNeXt-Tiny"].mean_accuracy == pytest.approx(81.64, abs=0.01)
    assert scores["MobileNet-V3"].mean_accuracy == pytest.approx(47.86, abs=0.01)
    assert scores["ConvNeXt-Tiny"].efficiency == pytest.approx(81.635 * 13.09 / 1000)


def test_constant_columns_score_zero_not_nan(spark):
    df = spark.createDataFrame([("a", 50.0, 10.0), ("b", 50.0, 10.0)], "model string, accuracy double, latency_ms double")
    for row in runs.weighted_scores(df).collect():
        assert row.score_balanced == 0.0


def test_weighted_scores(spark):
    df = spark.createDataFrame([("a", 50.0, 10.0), ("b", 70.0, 100.0)], "model string, accuracy double, latency_ms double")
    scores = {r.model: r for r in runs.weighted_scores(df).collect()}
    assert scores["a"].score_accuracy_priority == pytest.approx(0.3, abs=1e-4)
    assert scores["b"].score_edge_priority == pytest.approx(0.3, abs=1e-4)


def test_energy_columns(table):
    rows = {(r.dataset, r.model): r for r in runs.energy_columns(table).collect()}
    row = rows["Food-101", "ResNet50"]
    assert row.energy_j == pytest.approx(45.0 * 2244.8)
    assert row.energy_per_image_mj == pytest.approx(5000.0)
    assert row.accuracy_per_watt == pytest.approx(62.08 / 45)
    unknown = runs.energy_columns(table, {"ResNet50": 45.0}).filter("model = 'MobileNet-V3'").first()
    assert unknown.avg_power_w is None and unknown.energy_j is None


def test_quality_gate(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "dataset string, label int")
    gate = {r.dataset: (r.n_records, r.n_classes, r.passes) for r in runs.quality_gate(df, "label", ["dataset"], 2).collect()}
    assert gate == {"a": (2, 2, True), "b": (2, 1, False)}
    assert runs.assert_min_classes(df, "label", 2) is df
    with pytest.raises(ValueError, match="only 2 distinct"):
        runs.assert_min_classes(df, "label")
    with pytest.raises(ValueError, match="no records"):
        runs.assert_min_classes(df.limit(0), "label")


def test_quadrant(spark):
    df = spark.createDataFrame([("d", "a", 1.0), ("d", "b", 3.0), ("e", "a", 9.0)], "dataset string, model string, x double")
    assert {(r.dataset, r.model): r.x_side for r in runs.against_mean(df, ["x"]).collect()} == {
        ("d", "a"): "below",
        ("d", "b"): "above",
        ("e", "a"): "above",
    }


def test_latency_failures(spark):
    df = spark.createDataFrame([("m", "a", 2.0), ("m", "b", 4.0), ("m", None, 0.0)], "model string, prediction string, latency_s double")
    failed = F.col("prediction").isNull()
    assert timing.latency_throughput(df, failed).first()["mean_latency_s"] == 3.0
    assert timing.latency_throughput(df, failed, include_failures=True).first()["mean_latency_s"] == 2.0
    assert timing.latency_throughput(df, failed, eps=1e-6).first()["throughput"] == pytest.approx(1 / 3.000001)


def test_trial_stats(spark):
    ms = [100.0, 100.0] + [1.0, 3.0] + [5.0, 7.0]
    df = spark.createDataFrame([("m", i + 1, x) for i, x in enumerate(ms)], "model string, iter bigint, ms double")
    row = timing.trial_stats(df, warmup=2, runs=2).first()
    assert (row.latency_mean_ms, row.latency_std_ms, row.throughput) == (4.0, 2.0, 250.0)
    assert row.throughput_mean == pytest.approx((500 + 1000 / 6) / 2)
    assert timing.trial_stats(df, warmup=2, runs=2, repeats=1).first()["latency_mean_ms"] == 2.0


def hot(n=3000, seed=1):
    """One model holds most rows, one time stamp a third of them."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        model = "hot" if rng.random() < 0.7 else rng.choice(["x", "y"])
        t = 5_000_000 if rng.random() < 0.33 else rng.randrange(10_000_000)
        rows.append((model, t, i, float(rng.randrange(100))))
    return rows + [("single", 1, n, 42.0)]


def test_energy_against_brute_force(spark):
    rows = hot()
    df = spark.createDataFrame(rows, "model string, micros bigint, event_id bigint, power_w double").repartition(7)
    got = {r.model: r for r in timing.energy(df, idle_w=F.lit(30.0), total_time_s=9.0).collect()}
    for model in ("hot", "x", "y"):
        s = sorted((t, i, p) for m, t, i, p in rows if m == model)
        gross = sum((a[2] + b[2]) / 2 * (b[0] - a[0]) / 1e6 for a, b in zip(s, s[1:]))
        net = sum((max(0, a[2] - 30) + max(0, b[2] - 30)) / 2 * (b[0] - a[0]) / 1e6 for a, b in zip(s, s[1:]))
        assert got[model].energy_j == pytest.approx(gross)
        assert got[model].net_energy_j == pytest.approx(net)
        assert got[model].max_power_w == max(x[2] for x in s)
        assert got[model].n_samples == len(s)
    single = got["single"]
    assert (single.mean_power_w, single.energy_j, single.net_energy_j) == (30.0, 270.0, 0.0)


def test_row_numbers_against_brute_force(spark):
    rows = hot() + [(None, 3, 9_000, 1.0), (None, 2, 9_001, 1.0)]
    df = spark.createDataFrame(rows, "model string, t bigint, id bigint, x double").repartition(5)
    got = {(r.model, r.id): r.row_number for r in ordering.number_rows(df, ["model"], ["t", "id"]).collect()}
    assert len(got) == len(rows)
    for model in {r[0] for r in rows}:
        for place, (_, i) in enumerate(sorted((t, i) for m, t, i, _ in rows if m == model), 1):
            assert got[model, i] == place


def test_box_stats_against_brute_force(spark):
    rows = hot()
    df = spark.createDataFrame(rows, "model string, t bigint, id bigint, x double")
    got = {r.model: r for r in timing.box_stats(df, "x").collect()}
    for model in ("hot", "x", "y"):
        values = sorted(x for m, _, _, x in rows if m == model)
        q1, median, q3 = statistics.quantiles(values, n=4, method="inclusive")
        reach = 1.5 * (q3 - q1)
        inside = [v for v in values if q1 - reach <= v <= q3 + reach]
        row = got[model]
        assert (row.q1, row.median, row.q3) == pytest.approx((q1, median, q3))
        assert (row.whisker_low, row.whisker_high) == (inside[0], inside[-1])
        assert row.n_outliers == len(values) - len(inside)
    assert {r.model for r in timing.box_stats(df, "x", approx=True).collect()} == set(got)


def test_keep_first(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("l", 3, None)], "key string, priority int, x string")
    assert as_set(ordering.keep_first(df, ["key"], ["priority"])) == {("k", 1, "a"), ("l", 3, None)}


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_split_is_exact_and_repeatable(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    first = as_dict(sampling.split(df, "k"), "k", "subset")
    assert sum(s == "train" for s in first.values()) == int(0.8 * n)
    assert len(first) == n
    assert as_dict(sampling.split(df.repartition(3), "k"), "k", "subset") == first
    if n == 1000:
        assert as_dict(sampling.split(df, "k", seed=7), "k", "subset") != first


@pytest.mark.parametrize("n", [0, 1, 99, 300, 5000])
def test_sample_is_exact(spark, n):
    df = spark.range(300).withColumnRenamed("id", "k")
    got = [r.k for r in sampling.sample(df, "k", n).collect()]
    assert len(got) == len(set(got)) == min(n, 300)


REPEATS = {
    "ten of each": [(i // 10, i) for i in range(100)],
    "nulls": [(None if i < 30 else i, i) for i in range(100)],
    "one key": [(1, i) for i in range(100)],
    "equal rows": [(1, 1)] * 60 + [(None, None)] * 30 + [(2, 5)] * 10,
    "mixed": [(None, 1)] * 7 + [(3, 4)] * 20 + [(3, i) for i in range(50)] + [(i, 0) for i in range(23)],
}


@pytest.mark.parametrize("digits", [1, 4])
@pytest.mark.parametrize("rows", REPEATS.values(), ids=REPEATS.keys())
def test_exact_on_repeated_and_null_keys(spark, rows, digits):
    df = spark.createDataFrame(rows, "k long, x long").repartition(4)
    whole = collections.Counter(map(tuple, df.collect()))
    for n in (0, 1, 15, 20, 33, 79, 100, 500):
        got = collections.Counter(map(tuple, sampling.sample(df, "k", n, digits=digits).collect()))
        assert got.total() == min(n, 100) and not got - whole
        assert got == collections.Counter(map(tuple, sampling.sample(df.repartition(2), "k", n, digits=digits).collect()))
    for share in (0.0, 0.15, 0.8, 1.0):
        parts = sampling.split(df, "k", share, digits=digits).collect()
        assert sum(r.subset == "train" for r in parts) == int(share * 100)
        assert collections.Counter((r.k, r.x) for r in parts) == whole


def test_rows_of_one_key_stay_where_they_are(spark):
    """Only counts are shuffled, also where the cut goes through a key."""
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("x"))
    part = sampling.sample(df, "k", 1234)
    assert part.count() == 1234
    plan = part._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("Join", "Aggregate", "Sort", "Window"))


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "truth string, prediction string")


def test_undefined_class_metrics_are_zero(spark):
    df = scored(spark, [("a", "a"), ("a", "c"), ("b", "a")])  # b is never predicted, c never true
    report = {r.label: (r.precision, r.recall, r.f1, r.support) for r in metrics.class_report(df).collect()}
    assert report == {"a": (0.5, 0.5, 0.5, 2), "b": (0.0, 0.0, 0.0, 1), "c": (0.0, 0.0, 0.0, 0)}
    macro = metrics.macro_scores(df).first()
    assert macro.macro_f1 == pytest.approx(50 / 3)
    assert metrics.accuracy(df).first()["accuracy"] == pytest.approx(100 / 3)


def test_confusion(spark):
    df = scored(spark, [("a", "a"), ("a", "c"), ("b", "a"), ("b", "a")])
    assert as_set(metrics.confusion(df)) == {("a", "a", 1), ("a", "c", 1), ("b", "a", 2)}
    dense = {(r.truth, r.prediction): r.n for r in metrics.confusion_dense(df).collect()}
    assert len(dense) == 9 and dense["b", "a"] == 2 and dense["c", "c"] == 0


def test_dense_confusion_of_many_labels(spark):
    df = spark.range(60).select(F.concat(F.lit("t"), F.col("id")).alias("truth"), F.concat(F.lit("p"), F.col("id")).alias("prediction"))
    dense = metrics.confusion_dense(df)
    assert dense.count() == 120 * 120 and dense.agg(F.sum("n")).first()[0] == 60


def test_pivot_keys(spark):
    rows = [("m1", "A", 10.0), ("m1", "B", 90.0), ("m2", "B", 30.0)]
    table = spark.createDataFrame(rows, "model string, dataset string, accuracy double")
    got = {r.model: r for r in runs.metric_pivot(table, "accuracy", None, "mean").collect()}
    assert (got["m1"].A, got["m1"].B, got["m1"]["mean"]) == (10.0, 90.0, 50.0) and got["m2"].A is None
    with pytest.raises(PySparkException, match="B"):
        runs.metric_pivot(table, "accuracy", ["A"], "mean").collect()


def test_only_whole_repeats_count(spark):
    rows = [("m", i + 1, 10.0 if i < 115 else 1000.0) for i in range(117)]
    got = timing.trial_stats(spark.createDataFrame(rows, "model string, iter int, ms double")).first()
    assert (got.latency_mean_ms, got.latency_std_ms) == (10.0, 0.0)


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_rows_move_once(spark):
    """Ordered figures shuffle the rows once, by key and slice; the other exchange holds a row per slice."""
    power = spark.range(4000).select(F.lit("m").alias("model"), (F.col("id") * 7 % 4001).alias("micros"), F.col("id").alias("event_id"), F.lit(1.0).alias("power_w"))
    assert exchanges(timing.energy(power)) <= 2


def test_slices_split_a_hot_key(spark):
    """A key that holds nearly all rows is spread over its slices."""
    df = spark.range(20_000).select(F.when(F.col("id") < 19_900, F.lit("hot")).otherwise(F.lit("cold")).alias("k"), F.rand(3).alias("x"))
    sizes = [r["count"] for r in ordering.sliced(df, ["k"], ["x"], large=100).groupBy("k", ordering.SLICE).count().collect()]
    assert len(sizes) > 100 and max(sizes) < 20_000 / 20


def test_one_time_stamp_that_holds_a_whole_key_is_split(spark):
    df = spark.range(6000).select(F.lit("m").alias("k"), F.when(F.col("id") < 5700, F.lit(5)).otherwise(F.col("id")).alias("t"), F.col("id").alias("tie"))
    marked = ordering.sliced(df, ["k"], ["t", "tie"], large=100)
    slices = {r[ordering.SLICE]: (r.n, r.low, r.high) for r in marked.groupBy(ordering.SLICE).agg(F.count("*").alias("n"), F.min(F.struct("t", "tie")).alias("low"), F.max(F.struct("t", "tie")).alias("high")).collect()}
    assert len(slices) > 40 and max(n for n, _, _ in slices.values()) < 600
    edges = [tuple(x) for s in sorted(slices) for x in slices[s][1:]]
    assert edges == sorted(edges)  # slices are numbered like the rows


def test_a_hundred_thousand_keys(spark, monkeypatch):
    """Few keys are large: only those are cut, and the points are no value that each row searches through."""
    monkeypatch.setattr(ordering, "LARGE", 1000)
    small = spark.range(300_000).select((F.col("id") % 100_000).alias("k"), F.col("id").alias("x"))
    large = spark.range(30_000).select(F.lit(-1).cast("long").alias("k"), F.col("id").alias("x"))
    df = small.union(large).withColumn("tie", -F.col("x"))
    points = ordering.cuts(df, ["k"], ["x"]).collect()
    assert [r.k for r in points] == [-1] and len(points[0]["_points"]) >= 20
    numbered = ordering.number_rows(df, ["k"], ["x", "tie"])
    wrong = numbered.filter(F.when(F.col("k") < 0, F.col("x") + 1).otherwise(F.floor(F.col("x") / 100_000) + 1) != F.col("row_number"))
    assert wrong.count() == 0 and numbered.count() == 330_000


@pytest.fixture(params=[100_000, 20])
def sizes_of_slices(request, monkeypatch):
    """Figures must not depend on whether keys are cut."""
    monkeypatch.setattr(ordering, "LARGE", request.param)


@pytest.mark.usefixtures("sizes_of_slices")
def test_cut_keys_give_the_same_figures(spark):
    test_row_numbers_against_brute_force(spark)
    test_box_stats_against_brute_force(spark)
    rows = [("v", 3.0)] * 700 + [("v", float(i)) for i in range(300)] + [("w", 1.5)] * 50
    got = {r.model: (r.q1, r.median, r.q3) for r in timing.box_stats(spark.createDataFrame(rows, "model string, x double"), "x").collect()}
    for model in ("v", "w"):
        assert got[model] == pytest.approx(tuple(statistics.quantiles([x for m, x in rows if m == model], n=4, method="inclusive")))


def test_valid_pairs(spark):
    df = scored(spark, [("a", "a"), ("a", None), (None, "a"), ("a", "Error"), ("a", "Error_Processing")])
    assert metrics.valid_pairs(df).count() == 2
