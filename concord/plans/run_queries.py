"""Benchmark-run summaries, timing, power and data gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.operators import metrics, runs, timing
from concord.plans import views
from concord.plans.registry import query
from concord.plans.views import DATASETS, WATTS
from concord.plans.vote_queries import _rounded

# The runs view holds 6 decimals: at 6 again, a mean of two runs would often sit on a rounding tie.
def _rounded_8(df, *columns):
    return df.withColumns({c: F.round(c, 8) for c in columns})


METRICS = ["accuracy", "inference_time_s", "throughput", "latency_ms"]
_MEANS = "SELECT dataset, model, " + ", ".join(f"round(avg({m}), 8) AS {m}" for m in METRICS) + """
          FROM runs GROUP BY dataset, model"""


def _run_means(spark, sf):
    return runs.run_means(views.runs(spark, sf), METRICS, digits=8)


@query("run_means", _MEANS)
def run_means(spark, sf):
    return _run_means(spark, sf)


@query(
    "best_by",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, dataset, model, {m} AS value FROM (
              SELECT * FROM ({_MEANS}) ORDER BY {m} {order}, dataset, model LIMIT 1)"""
        for m, order in (("accuracy", "DESC"), ("throughput", "DESC"), ("latency_ms", "ASC"))
    ),
)
def best_by(spark, sf):
    return runs.best_by(_run_means(spark, sf), ["accuracy", "throughput"], ["latency_ms"])


@query(
    "mean_std",
    "SELECT dataset, model, "
    + ", ".join(
        f"round(avg({m}), 8) AS {m}_mean, round(stddev_samp({m}), 8) AS {m}_std" for m in ("accuracy", "latency_ms")
    )
    + " FROM runs GROUP BY dataset, model",
)
def mean_std(spark, sf):
    spread = runs.mean_std(views.runs(spark, sf), ["accuracy", "latency_ms"])
    return _rounded_8(spread, *[c for c in spread.columns if c.endswith(("_mean", "_std"))])


@query(
    "accuracy_pivot",
    "SELECT model, "
    + ", ".join(f"round({d}, 8) AS {d}" for d in DATASETS)
    + ", round((" + " + ".join(f"coalesce({d}, 0e0)" for d in DATASETS) + ") / ("
    + " + ".join(f"CASE WHEN {d} IS NULL THEN 0 ELSE 1 END" for d in DATASETS)
    + "), 8) AS mean_accuracy FROM (SELECT model, "
    + ", ".join(f"avg(CASE WHEN dataset = '{d}' THEN accuracy END) AS {d}" for d in DATASETS)
    + " FROM runs GROUP BY model)",
)
def accuracy_pivot(spark, sf):
    table = runs.metric_pivot(views.runs(spark, sf), "accuracy", DATASETS, "mean_accuracy")
    return _rounded_8(table, *DATASETS, "mean_accuracy")


_SUMMARY = "SELECT model, avg(accuracy) AS accuracy, avg(latency_ms) AS latency_ms FROM runs GROUP BY model"


@query(
    "sensitivity",
    f"""SELECT model, round(accuracy, 8) AS accuracy, round(latency_ms, 8) AS latency_ms,
               round(0.7e0 * a + 0.3e0 * l, 8) AS score_accuracy_priority,
               round(0.5e0 * a + 0.5e0 * l, 8) AS score_balanced,
               round(0.3e0 * a + 0.7e0 * l, 8) AS score_edge_priority
        FROM (SELECT model, accuracy, latency_ms,
                     (accuracy - min(accuracy) OVER ()) / (max(accuracy) OVER () - min(accuracy) OVER () + 1e-6) AS a,
                     (i - min(i) OVER ()) / (max(i) OVER () - min(i) OVER () + 1e-6) AS l
              FROM (SELECT *, 1e0 / (latency_ms + 1e-6) AS i FROM ({_SUMMARY})))""",
)
def sensitivity(spark, sf):
    summary = views.runs(spark, sf).groupBy("model").agg(
        F.avg("accuracy").alias("accuracy"), F.avg("latency_ms").alias("latency_ms")
    )
    scores = runs.weighted_scores(summary)
    return _rounded_8(scores, *scores.columns[1:])


@query(
    "efficiency",
    """SELECT model, round(avg(a), 8) AS mean_accuracy, round(avg(t), 8) AS mean_throughput,
              round(avg(a) * avg(t) / 1000e0, 8) AS efficiency
       FROM (SELECT dataset, model, avg(accuracy) AS a, avg(throughput) AS t FROM runs GROUP BY dataset, model)
       GROUP BY model""",
)
def efficiency(spark, sf):
    scores = runs.efficiency_score(views.runs(spark, sf))
    return _rounded_8(scores, *scores.columns[1:])


_ENERGY = """SELECT r.dataset, r.model, r.run, r.accuracy, r.throughput, r.latency_ms, w.w AS avg_power_w,
                    w.w * r.inference_time_s AS energy_j, w.w / r.throughput * 1000e0 AS energy_per_image_mj,
                    r.accuracy / w.w AS accuracy_per_watt, r.throughput / w.w AS throughput_per_watt
             FROM runs r LEFT JOIN watts w ON r.model = w.model"""


@query(
    "energy_cols",
    "SELECT dataset, model, run, " + ", ".join(f"round({m}, 8) AS {m}" for m in runs.ENERGY_METRICS) + f" FROM ({_ENERGY})",
)
def energy_cols(spark, sf):
    table = runs.energy_columns(views.runs(spark, sf), WATTS)
    return _rounded_8(table, *runs.ENERGY_METRICS).select("dataset", "model", "run", *runs.ENERGY_METRICS)


@query(
    "energy_summary",
    "SELECT model, " + ", ".join(f"round(avg({m}), 8) AS {m}" for m in runs.ENERGY_METRICS) + f" FROM ({_ENERGY}) GROUP BY model",
)
def energy_summary(spark, sf):
    return _rounded_8(runs.energy_summary(runs.energy_columns(views.runs(spark, sf), WATTS)), *runs.ENERGY_METRICS)


@query(
    "box_stats",
    """SELECT e.event_type AS model, round(max(q.q1), 6) AS q1, round(max(q.median), 6) AS median,
              round(max(q.q3), 6) AS q3,
              min(CASE WHEN value BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) THEN value END) AS whisker_low,
              max(CASE WHEN value BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) THEN value END) AS whisker_high,
              count(CASE WHEN NOT (value BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)) THEN 1 END)
                AS n_outliers
       FROM events e JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                                  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type) q
         ON e.event_type = q.event_type GROUP BY e.event_type""",
)
def box_stats(spark, sf):
    events = views.table(spark, sf, "events").select(F.col("event_type").alias("model"), "value")
    return _rounded(timing.box_stats(events, "value"), "q1", "median", "q3")


@query(
    "trial_stats",
    """SELECT model, round(avg(ms), 6) AS latency_mean_ms, round(stddev_pop(ms), 6) AS latency_std_ms,
              round(avg(1000e0 / ms), 6) AS throughput_mean, round(stddev_pop(1000e0 / ms), 6) AS throughput_std,
              round(1000e0 / avg(ms), 6) AS throughput
       FROM (SELECT model, (iter - 16) // 50 AS repeat, avg(ms) AS ms FROM trials WHERE iter > 15
             GROUP BY model, repeat HAVING count(*) = 50) GROUP BY model""",
)
def trial_stats(spark, sf):
    stats = timing.trial_stats(views.trials(spark, sf))
    return _rounded(stats, *stats.columns[1:])


_AREAS = """SELECT model, count(*) AS n_samples, round(avg(power_w), 6) AS mean_power_w, max(power_w) AS max_power_w,
                   round(sum((power_w + p) / 2e0 * date_diff('microsecond', t, ts) / 1e6), 3) AS energy_j,
                   round(sum((net + n) / 2e0 * date_diff('microsecond', t, ts) / 1e6), 3) AS net_energy_j
            FROM (SELECT *, lag(ts) OVER w AS t, lag(power_w) OVER w AS p, lag(net) OVER w AS n FROM (
                    SELECT *, greatest(0e0, power_w - (SELECT avg(power_w) FROM power WHERE model = 'view')) AS net
                    FROM power)
                  WINDOW w AS (PARTITION BY model ORDER BY ts, event_id)) GROUP BY model"""


@query("energy_trapz", f"SELECT model, n_samples, mean_power_w, max_power_w, energy_j FROM ({_AREAS})")
def energy_trapz(spark, sf):
    table = timing.energy(views.power(spark, sf)).drop("net_energy_j")
    return table.withColumns({"mean_power_w": F.round("mean_power_w", 6), "energy_j": F.round("energy_j", 3)})


@query("net_energy", f"SELECT model, energy_j, net_energy_j FROM ({_AREAS})")
def net_energy(spark, sf):
    samples = views.power(spark, sf)
    idle = timing.idle_power(samples.filter("model = 'view'"))
    table = timing.energy(samples, idle_w=idle).select("model", "energy_j", "net_energy_j")
    return table.withColumns({c: F.round(c, 3) for c in ("energy_j", "net_energy_j")})


@query(
    "quality_gate",
    """SELECT source AS dataset, count(*) AS n_records, count(DISTINCT lang) AS n_classes,
              count(DISTINCT lang) >= 4 AS passes FROM documents GROUP BY source""",
)
def quality_gate(spark, sf):
    documents = views.table(spark, sf, "documents").select(F.col("source").alias("dataset"), "lang")
    return runs.quality_gate(documents, "lang", ["dataset"], min_classes=4)


@query(
    "quadrant",
    f"""SELECT dataset, model, accuracy, throughput,
               CASE WHEN accuracy >= avg(accuracy) OVER w THEN 'above' ELSE 'below' END AS accuracy_side,
               CASE WHEN throughput >= avg(throughput) OVER w THEN 'above' ELSE 'below' END AS throughput_side
        FROM ({_MEANS}) WINDOW w AS (PARTITION BY dataset)""",
)
def quadrant(spark, sf):
    summary = _run_means(spark, sf).select("dataset", "model", "accuracy", "throughput")
    return runs.against_mean(summary, ["accuracy", "throughput"])


@query("peak_gauge", "SELECT model, max(power_w) AS peak FROM power GROUP BY model")
def peak_gauge(spark, sf):
    return timing.peak(views.power(spark, sf), "power_w")


@query(
    "epoch_accuracy",
    """SELECT epoch, round(100e0 * sum(CASE WHEN truth = prediction THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
       FROM epoch_log GROUP BY epoch""",
)
def epoch_accuracy(spark, sf):
    return _rounded(metrics.accuracy(views.epoch_log(spark, sf), ["epoch"]), "accuracy")
