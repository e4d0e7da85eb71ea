"""Stand-in inputs over the driver tables, in Spark and as SQL text for the oracle.

The Spark side may build a view in another way than its SQL, never with
another result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import cleaning, fixed_values
from concord.operators import neighbours, ordering, timing, votes

VOTERS = {n: f"m{n}" for n in range(1, 8)}
MODELS = list(VOTERS.values())
DATASETS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

FAMILY_OF = {
    "m1": "CNNs",
    "m2": "CNNs",
    "m3": "CNNs",
    "m4": "Transformers",
    "m5": "Transformers",
    "m6": "Vision-Language",
    "m7": "Other",
}
FAMILIES = ["CNNs", "Transformers", "Vision-Language", "Hybrid"]
WATTS = {"m1": 45.0, "m2": 18.0, "m3": 42.0, "m4": 50.0, "m5": 44.0, "m6": 12.0}


#: Most bytes that a task over votes reads from files or, compressed, from a shuffle.
FILE_BYTES, SHUFFLE_BYTES = 16 << 20, 8 << 20
#: Shares of a shuffle for each task that reads files, before Spark joins small ones.
SHARES = 4


def bounded(spark: SparkSession, rows: DataFrame) -> None:
    """Tasks over votes take a fixed share of ``rows``: they sort what they read, in some 25 times the compressed bytes.

    Spark joins small shares but splits none, so there are enough from the start, whatever the session's number of them.
    """
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(FILE_BYTES))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(SHUFFLE_BYTES))
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), SHARES * rows.rdd.getNumPartitions())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(shares))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def votes_wide(spark: SparkSession, sf_dir: str, latency: bool = False) -> DataFrame:
    """One row per order with ``m1..m7``, raw predictions, and maybe ``m1_time..m7_time``."""
    rows = table(spark, sf_dir, "lineitem")
    bounded(spark, rows)
    failed = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O") & (F.col("l_quantity") < 10)
    whole = F.concat("l_returnflag", "l_linestatus")
    label = F.when(failed, F.lit(fixed_values.ERROR_PROCESSING)).otherwise(whole)
    measures = {"": label, "_time": F.col("l_quantity")} if latency else {"": label}
    return votes.collapse(rows, F.col("l_orderkey"), F.col("l_linenumber"), VOTERS, measures)


def clean_wide(spark: SparkSession, sf_dir: str, listed: bool = False) -> DataFrame:
    return votes.clean(_restricted(spark, sf_dir, votes_wide(spark, sf_dir), listed), MODELS)


def _restricted(spark: SparkSession, sf_dir: str, wide: DataFrame, listed: bool) -> DataFrame:
    """With ``listed``, listed records alone: a row an item meets the listing, sorted as it is, and not one a vote."""
    return votes.aligned(wide, listing(spark, sf_dir)) if listed else wide


def raw_votes(spark: SparkSession, sf_dir: str, latency: bool = False, listed: bool = False) -> DataFrame:
    """``item_id, model, raw_prediction``, maybe ``latency_s``, partitioned by item; maybe of listed records alone."""
    values = {"raw_prediction": "", "latency_s": "_time"} if latency else {"raw_prediction": ""}
    return votes.lengthen(_restricted(spark, sf_dir, votes_wide(spark, sf_dir, latency), listed), MODELS, values)


def clean_votes(spark: SparkSession, sf_dir: str, latency: bool = False, listed: bool = False) -> DataFrame:
    raw = raw_votes(spark, sf_dir, latency, listed)
    return raw.withColumn("prediction", cleaning.null_errors(F.col("raw_prediction")))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record, with or without votes."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_quantity"
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    seconds = F.sum("l_quantity") / 100.0
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy("p_type", "l_linenumber", "l_linestatus")
        .agg(
            F.count(F.lit(1)).alias("test_samples"),
            F.round(F.lit(100.0) * F.count_if(F.col("l_returnflag") == "A") / F.count(F.lit(1)), 6).alias("accuracy"),
            F.round(seconds, 6).alias("inference_time_s"),
            F.round(F.count(F.lit(1)) / seconds, 6).alias("throughput"),
            F.round(F.avg("l_quantity"), 6).alias("latency_ms"),
        )
        .select(
            F.col("p_type").alias("dataset"),
            F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"),
            F.col("l_linestatus").alias("run"),
            "test_samples",
            "accuracy",
            "inference_time_s",
            "throughput",
            "latency_ms",
        )
    )


def power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"),
        timing.epoch_micros(F.col("ts")).alias("micros"),
        "event_id",
        F.col("value").alias("power_w"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"), "ts", "event_id", F.col("value").alias("ms")
    )
    return ordering.number_rows(log, ["model"], ["ts", "event_id"], "iter").select("model", "iter", "ms")


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 3 + 1).alias("epoch"),
        F.col("l_returnflag").alias("truth"),
        F.when(F.col("l_linestatus") == "O", F.lit("A")).otherwise(F.col("l_returnflag")).alias("prediction"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embeddings(spark, sf_dir)
    return neighbours.nearest_centroid(vectors, neighbours.centroids(vectors))


# The same views as SQL for the oracle; each may use the ones before it.
SQL_VIEWS = {
    "votes": """
        SELECT l_orderkey AS item_id,
               concat('m', cast(l_linenumber AS varchar(10))) AS model,
               min(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity < 10
                        THEN 'Error_Processing'
                        ELSE concat(l_returnflag, l_linestatus) END) AS raw_prediction,
               min(l_quantity) AS latency_s
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "clean": """
        SELECT item_id, model, raw_prediction, latency_s,
               CASE WHEN raw_prediction LIKE '%Error%' THEN NULL ELSE raw_prediction END AS prediction
        FROM votes""",
    "wide": "SELECT item_id, "
    + ", ".join(f"max(CASE WHEN model = '{m}' THEN raw_prediction END) AS {m}" for m in MODELS)
    + ", "
    + ", ".join(f"max(CASE WHEN model = '{m}' THEN latency_s END) AS {m}_time" for m in MODELS)
    + " FROM votes GROUP BY item_id",
    "total": "SELECT count(*) AS n_records FROM orders",
    "listed": "SELECT * FROM clean WHERE item_id IN (SELECT o_orderkey FROM orders)",
    "label_n": "SELECT item_id, prediction, count(prediction) AS n FROM clean GROUP BY item_id, prediction",
    "top_sets": """
        SELECT DISTINCT item_id, prediction FROM clean WHERE prediction IN (
          SELECT prediction FROM clean WHERE prediction IS NOT NULL
          GROUP BY prediction ORDER BY count(*) DESC, prediction LIMIT 20)""",
    "cons": """
        SELECT item_id,
               max(CASE WHEN rn = 1 THEN prediction END) AS majority,
               max(n) AS top_votes, cast(sum(n) AS bigint) AS n_votes, count(prediction) AS n_labels
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, prediction) AS rn FROM label_n)
        GROUP BY item_id""",
    "all_cons": """
        SELECT o.o_orderkey AS item_id, c.majority, coalesce(c.top_votes, 0) AS top_votes,
               coalesce(c.n_votes, 0) AS n_votes, coalesce(c.n_labels, 0) AS n_labels
        FROM orders o LEFT JOIN cons c ON o.o_orderkey = c.item_id""",
    "pairs": """
        SELECT a.model AS model_a, b.model AS model_b, count(*) AS n_both,
               sum(CASE WHEN a.prediction = b.prediction THEN 1 ELSE 0 END) AS n_same
        FROM clean a JOIN clean b ON a.item_id = b.item_id
        WHERE a.prediction IS NOT NULL AND b.prediction IS NOT NULL
        GROUP BY a.model, b.model""",
    "listed_pairs": """
        SELECT a.model AS model_a, b.model AS model_b,
               sum(CASE WHEN a.prediction = b.prediction THEN 1 ELSE 0 END) AS n_same
        FROM listed a JOIN listed b ON a.item_id = b.item_id
        WHERE a.prediction IS NOT NULL AND b.prediction IS NOT NULL
        GROUP BY a.model, b.model""",
    "runs": """
        SELECT p.p_type AS dataset, concat('m', cast(l.l_linenumber AS varchar(10))) AS model,
               l.l_linestatus AS run, count(*) AS test_samples,
               round(100e0 * sum(CASE WHEN l.l_returnflag = 'A' THEN 1 ELSE 0 END) / count(*), 6) AS accuracy,
               round(sum(l.l_quantity) / 100e0, 6) AS inference_time_s,
               round(count(*) / (sum(l.l_quantity) / 100e0), 6) AS throughput,
               round(avg(l.l_quantity), 6) AS latency_ms
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
        GROUP BY p.p_type, l.l_linenumber, l.l_linestatus""",
    "power": "SELECT event_type AS model, ts, event_id, value AS power_w FROM events",
    "trials": """
        SELECT event_type AS model, value AS ms,
               row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS iter
        FROM events""",
    "epoch_log": """
        SELECT (l_linenumber % 3) + 1 AS epoch, l_returnflag AS truth,
               CASE WHEN l_linestatus = 'O' THEN 'A' ELSE l_returnflag END AS prediction
        FROM lineitem""",
    "cells": """
        SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding)::double AS x
        FROM embeddings""",
    "centres": "SELECT label, pos, avg(x) AS c FROM cells GROUP BY label, pos",
    "centre_distance": """
        SELECT v.vec_id, v.label AS truth, c.label AS prediction, sum((v.x - c.c) * (v.x - c.c)) AS d
        FROM cells v JOIN centres c ON v.pos = c.pos GROUP BY v.vec_id, v.label, c.label""",
    "scored": """
        SELECT vec_id, truth, prediction, d FROM (
          SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), prediction) AS rn
          FROM centre_distance) WHERE rn = 1""",
    "report": """
        SELECT label, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (
          SELECT truth AS label, CASE WHEN truth = prediction THEN 1 ELSE 0 END AS tp, 1 AS support, 0 AS predicted
          FROM scored
          UNION ALL SELECT prediction, 0, 0, 1 FROM scored) GROUP BY label""",
    "family": "SELECT * FROM (VALUES "
    + ", ".join(f"('{m}', '{f}')" for m, f in FAMILY_OF.items())
    + ") AS t(model, family)",
    "watts": "SELECT * FROM (VALUES "
    + ", ".join(f"('{m}', {w}e0)" for m, w in WATTS.items())
    + ") AS t(model, w)",
}


def sql(body: str) -> str:
    """``body`` preceded by the views it reads, and those they read, as CTEs."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in set(re.findall(r"\b(?:FROM|JOIN) (\w+)", text)) & SQL_VIEWS.keys() - needed:
            needed.add(name)
            need(SQL_VIEWS[name])

    need(body)
    ctes = [f"{name} AS ({text})" for name, text in SQL_VIEWS.items() if name in needed]
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
