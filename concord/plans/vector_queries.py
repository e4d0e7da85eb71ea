"""Scores, embeddings, neighbours, classification metrics and user-supplied scorers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from concord.functions import vectors
from concord.operators import metrics, neighbours, probe, scoring
from concord.plans import views
from concord.plans.registry import query
from concord.plans.vote_queries import _rounded


def _cells(df, key: str, vector, name: str = "value"):
    """One row per vector position, values at 6 decimals."""
    cells = df.select(key, F.posexplode(vector).alias("pos", name))
    return cells.select(key, F.col("pos").cast("bigint").alias("pos"), F.round(F.col(name).cast("double"), 6).alias(name))


SCORE_LABELS = {i: f"label_{i}" for i in range(0, 64, 2)}


@query(
    "argmax_label",
    """SELECT vec_id, CASE WHEN pos % 2 = 0 THEN concat('label_', cast(pos AS varchar)) ELSE cast(pos AS varchar) END
              AS prediction
       FROM (SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, pos) AS rn FROM cells)
       WHERE rn = 1""",
)
def argmax_label(spark, sf):
    prediction = vectors.argmax_label(F.col("embedding"), SCORE_LABELS)
    return views.embeddings(spark, sf).select("vec_id", prediction.alias("prediction"))


@query(
    "softmax",
    """SELECT vec_id, pos, round(exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY vec_id), 6) AS value
       FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM cells)""",
)
def softmax(spark, sf):
    return _cells(views.embeddings(spark, sf), "vec_id", vectors.softmax(F.col("embedding")))


@query("sigmoid", "SELECT vec_id, pos, round(1e0 / (1e0 + exp(-x)), 6) AS value FROM cells")
def sigmoid(spark, sf):
    return _cells(views.embeddings(spark, sf), "vec_id", vectors.sigmoid(F.col("embedding")))


@query(
    "l2_normalize",
    "SELECT vec_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS value FROM cells",
)
def l2_normalize(spark, sf):
    return _cells(views.embeddings(spark, sf), "vec_id", vectors.l2_normalize(F.col("embedding")))


@query("mean_pool", "SELECT label, pos, round(c, 6) AS value FROM centres")
def mean_pool(spark, sf):
    return _cells(neighbours.centroids(views.embeddings(spark, sf)), "label", F.col("embedding"))


@query(
    "mean_pool_tokens",
    "SELECT vec_id, pos % 8 AS pos, round(avg(x), 6) AS value FROM cells GROUP BY vec_id, pos % 8",
)
def mean_pool_tokens(spark, sf):
    tokens = vectors.to_matrix(F.col("embedding"), 8)
    return _cells(views.embeddings(spark, sf), "vec_id", vectors.mean_pool(tokens))


@query("flatten_vec", "SELECT vec_id, pos, round(x, 6) AS value FROM cells")
def flatten_vec(spark, sf):
    tokens = vectors.to_matrix(F.col("embedding"), 8)
    return _cells(views.embeddings(spark, sf), "vec_id", vectors.flatten(tokens))


def _first_vector(vecs):
    """The search query: the first record."""
    return vecs.agg(F.min_by(F.struct(F.col("vec_id").alias("query_id"), "embedding"), "vec_id").alias("q")).select("q.*")


_RANKED = """SELECT query_id, vec_id, rank, round(d, 6) AS distance_sq, round(sqrt(d), 6) AS distance FROM (
               SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS rank FROM ({0}))
             WHERE rank <= 5"""


@query(
    "knn_l2",
    _RANKED.format(
        """SELECT q.vec_id AS query_id, v.vec_id, sum((v.x - q.x) * (v.x - q.x)) AS d FROM cells v
           JOIN cells q ON v.pos = q.pos WHERE q.vec_id = (SELECT min(vec_id) FROM embeddings)
           GROUP BY q.vec_id, v.vec_id"""
    ),
)
def knn_l2(spark, sf):
    vecs = views.embeddings(spark, sf)
    return _rounded(neighbours.nearest(vecs, _first_vector(vecs), k=5), "distance_sq", "distance")


@query(
    "knn_centroids",
    _RANKED.format(
        """SELECT q.label AS query_id, v.vec_id, sum((v.x - q.c) * (v.x - q.c)) AS d FROM cells v
           JOIN centres q ON v.pos = q.pos GROUP BY q.label, v.vec_id"""
    ),
)
def knn_centroids(spark, sf):
    vecs = views.embeddings(spark, sf)
    queries = neighbours.centroids(vecs).withColumnRenamed("label", "query_id")
    return _rounded(neighbours.nearest(vecs, queries, k=5), "distance_sq", "distance")


def _every(vecs, n):
    """The search queries: all records whose id ``n`` divides."""
    return vecs.filter(F.col("vec_id") % n == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@query(
    "knn_many",
    _RANKED.format(
        """SELECT q.vec_id AS query_id, v.vec_id, sum((v.x - q.x) * (v.x - q.x)) AS d FROM cells v
           JOIN cells q ON v.pos = q.pos WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, v.vec_id"""
    ),
)
def knn_many(spark, sf):
    vecs = views.embeddings(spark, sf)
    return _rounded(neighbours.nearest_many(vecs, _every(vecs, 20), k=5), "distance_sq", "distance")


@query(
    "knn_lsh",
    """SELECT count(*) AS n_queries, 5 * count(*) AS n_found, true AS self_first, true AS exact_distances,
              true AS recall_met FROM embeddings WHERE vec_id % 50 = 0 HAVING count(*) > 0""",
)
def knn_lsh(spark, sf):
    """What holds for the hashed search of many records: k rows each, themselves first, exact distances, and recall."""
    vecs = views.embeddings(spark, sf)
    queries = _every(vecs, 50)
    found = neighbours.nearest_lsh(vecs, queries, k=5)
    exact = neighbours.nearest(vecs, queries, k=5).select("query_id", "vec_id", F.col("distance").alias("true_distance"))
    both = found.join(exact, ["query_id", "vec_id"], "full")
    right = F.col("true_distance").isNull() | F.col("distance").isNull() | (F.abs(F.col("distance") - F.col("true_distance")) < 1e-6)
    return both.agg(
        F.count_distinct("query_id").alias("n_queries"),
        F.count("distance").alias("n_found"),
        F.bool_and((F.col("rank") != 1) | (F.col("vec_id") == F.col("query_id"))).alias("self_first"),
        F.bool_and(right).alias("exact_distances"),
        (F.count_if(F.col("distance").isNotNull() & F.col("true_distance").isNotNull()) >= 0.9 * F.count("true_distance")).alias(
            "recall_met"
        ),
    )


@query(
    "centroid_predict",
    "SELECT vec_id, truth, prediction, round(d, 6) AS distance_sq FROM scored",
)
def centroid_predict(spark, sf):
    return _rounded(views.scored(spark, sf), "distance_sq")


@query(
    "accuracy",
    """SELECT round(100e0 * sum(CASE WHEN truth = prediction THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
       FROM scored""",
)
def accuracy(spark, sf):
    return _rounded(metrics.accuracy(views.scored(spark, sf)), "accuracy")


_REPORT = """SELECT label, CASE WHEN predicted > 0 THEN tp / predicted::double ELSE 0e0 END AS precision,
                    CASE WHEN support > 0 THEN tp / support::double ELSE 0e0 END AS recall,
                    2e0 * tp / (predicted + support) AS f1, cast(support AS bigint) AS support FROM report"""


@query(
    "macro_prf",
    f"""SELECT round(100e0 * avg(precision), 6) AS macro_precision, round(100e0 * avg(recall), 6) AS macro_recall,
               round(100e0 * avg(f1), 6) AS macro_f1 FROM ({_REPORT})""",
)
def macro_prf(spark, sf):
    scores = metrics.macro_scores(views.scored(spark, sf))
    return _rounded(scores, *scores.columns)


@query(
    "class_report",
    f"""SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
        FROM ({_REPORT})""",
)
def class_report(spark, sf):
    return _rounded(metrics.class_report(views.scored(spark, sf)), "precision", "recall", "f1")


@query(
    "confusion",
    """SELECT a.label AS truth, b.label AS prediction, count(s.vec_id) AS n FROM report a CROSS JOIN report b
       LEFT JOIN scored s ON s.truth = a.label AND s.prediction = b.label GROUP BY a.label, b.label""",
)
def confusion(spark, sf):
    return metrics.confusion_dense(views.scored(spark, sf))


def _class_sums(matrix: np.ndarray) -> np.ndarray:
    """Scores of a fixed linear model: class c sums the positions p with p % 10 == c."""
    return np.stack([matrix[:, c::10].sum(axis=1) for c in range(10)], axis=1)


def linear_scorer():
    """A deterministic scorer that refuses vectors whose first value is above 0.2."""

    def score(batch):
        matrix = np.stack(batch["embedding"].to_numpy()).astype("float64")
        if (matrix[:, 0] > 0.2).any():
            raise ValueError("first value too large")
        return [f"class_{i}" for i in _class_sums(matrix).round(9).argmax(axis=1)]

    return score


_CLASS_SUMS = """SELECT vec_id, label, c, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, c) AS rn
                 FROM (SELECT vec_id, label, pos % 10 AS c, sum(x) AS s FROM cells GROUP BY vec_id, label, pos % 10)"""


@query(
    "score_partitions",
    f"""SELECT p.vec_id, CASE WHEN f.x > 0.2e0 THEN 'Error_Processing' ELSE concat('class_', cast(p.c AS varchar)) END
               AS prediction
        FROM ({_CLASS_SUMS}) p JOIN cells f ON p.vec_id = f.vec_id AND f.pos = 0 WHERE p.rn = 1""",
)
def score_partitions(spark, sf):
    vecs = views.embeddings(spark, sf)
    return scoring.score_partitions(vecs, linear_scorer, ["embedding"], key="vec_id")


def letter_counts():
    """A deterministic embedding of texts: how often each letter a to z occurs."""

    def vectors(texts):
        octets = [np.frombuffer(text.encode("utf-8"), dtype="uint8") for text in texts]
        return [np.bincount(o, minlength=256)[97:123].astype("float32") for o in octets]

    return vectors


def long_letter_counts():
    """As ``letter_counts``, refusing batches that hold a text with fewer than 20 letters."""
    count = letter_counts()

    def vectors(texts):
        found = count(texts)
        if any(v.sum() < 20 for v in found):
            raise ValueError("too few letters")
        return found

    return vectors


_LETTERS = """SELECT doc_id, pos, cast(length(text) - length(replace(text, chr(cast(97 + pos AS int)), '')) AS double) AS value
              FROM (SELECT doc_id, text, unnest(range(26)) AS pos FROM documents)"""


@query("embed_udf", f"SELECT doc_id, pos, value FROM ({_LETTERS})")
def embed_udf(spark, sf):
    embed = scoring.embed_column(letter_counts)
    documents = views.table(spark, sf, "documents").select("doc_id", embed(F.col("text")).alias("embedding"))
    return _cells(documents, "doc_id", F.col("embedding"))


@query(
    "embed_drop_bad",
    f"""SELECT doc_id, pos, round(cast(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS float)::double, 6) AS value
        FROM (SELECT *, sum(value) OVER (PARTITION BY doc_id) AS letters FROM ({_LETTERS})) WHERE letters >= 20""",
)
def embed_drop_bad(spark, sf):
    documents = views.table(spark, sf, "documents").select("doc_id", "text")
    found = scoring.embed_partitions(documents, long_letter_counts, key="doc_id", content="text")
    return _cells(found, "doc_id", F.col("embedding"))


def grid_scorer(model: str):
    """Predicts the return flag from the line status in a way that depends on the model; m7 fails to load."""
    if model == "m7":
        raise RuntimeError("no weights")
    flags = {"O": "N", "F": "A"} if model in ("m1", "m2", "m3") else {"O": "R", "F": "R"}

    def score(batch):
        return [flags[s] for s in batch["status"]]

    return score


_GRID = """SELECT p.p_type AS dataset, l.l_linenumber AS m, l.l_returnflag AS truth,
                  CASE WHEN l.l_linenumber > 3 THEN 'R' WHEN l.l_linestatus = 'O' THEN 'N' ELSE 'A' END AS prediction
           FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_linenumber < 7"""
_GRID_LABELS = f"""SELECT dataset, m, label, sum(tp) AS tp, sum(s) AS s, sum(q) AS q FROM (
                     SELECT dataset, m, truth AS label, CASE WHEN truth = prediction THEN 1 ELSE 0 END AS tp, 1 AS s, 0 AS q
                     FROM ({_GRID}) UNION ALL SELECT dataset, m, prediction, 0, 0, 1 FROM ({_GRID}))
                   GROUP BY dataset, m, label"""


@query(
    "evaluate_grid",
    f"""SELECT dataset, concat('m', cast(m AS varchar)) AS model, count(CASE WHEN s > 0 THEN 1 END) AS num_classes,
               cast(sum(s) AS bigint) AS test_samples, round(100e0 * sum(tp) / sum(s), 6) AS accuracy,
               round(100e0 * avg(CASE WHEN q > 0 THEN tp::double / q ELSE 0e0 END), 6) AS macro_precision,
               round(100e0 * avg(CASE WHEN s > 0 THEN tp::double / s ELSE 0e0 END), 6) AS macro_recall,
               round(100e0 * avg(2e0 * tp / (q + s)), 6) AS macro_f1, NULL AS error
        FROM ({_GRID_LABELS}) GROUP BY dataset, m
        UNION ALL SELECT DISTINCT p.p_type, 'm7', NULL::bigint, NULL::bigint, NULL::double, NULL::double, NULL::double,
               NULL::double, 'RuntimeError: no weights'
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_linenumber = 7""",
)
def evaluate_grid(spark, sf):
    lines = views.table(spark, sf, "lineitem").select("l_partkey", "l_linenumber", "l_linestatus", "l_returnflag")
    parts = views.table(spark, sf, "part").select("p_partkey", "p_type")
    records = lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("p_type").alias("dataset"),
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"),
        F.col("l_linestatus").alias("status"),
        F.col("l_returnflag").alias("truth"),
    )
    grid = scoring.evaluate_grid(records, grid_scorer, ["status"])
    return _rounded(grid, "accuracy", *[f"macro_{c}" for c in metrics.MACRO])


@query(
    "linear_probe",
    """SELECT vec_id, truth, truth AS prediction FROM (
         SELECT vec_id, CASE WHEN x > 0 THEN 'right' ELSE 'left' END AS truth,
                row_number() OVER (ORDER BY md5(concat(cast(vec_id AS varchar), ':42')), vec_id) AS rn,
                count(*) OVER () AS n
         FROM cells WHERE pos = 0 AND abs(x) >= 0.05e0)
       WHERE rn > cast(floor(0.8e0 * n) AS bigint)""",
)
def linear_probe(spark, sf):
    """The test part of a split, each row with its class: the classes are the sides of a gap, which a probe must find."""
    first = F.col("embedding")[0].cast("double")
    sides = views.embeddings(spark, sf).filter(F.abs(first) >= 0.05).select(
        "vec_id",
        F.when(first > 0, F.lit("right")).otherwise(F.lit("left")).alias("label"),
        F.slice("embedding", 1, 4).alias("embedding"),
    )
    return probe.linear_probe(sides, rate=0.5)
