"""Agreement, consensus and divergence over the vote views."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions import fixed_values as fixed
from concord.operators import consensus, joins, pairs, timing
from concord.plans import views
from concord.plans.registry import query
from concord.plans.views import FAMILIES, FAMILY_OF, MODELS


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _consensus(spark, sf):
    return consensus.with_consensus(views.clean_wide(spark, sf), MODELS)


def _judged(spark, sf, listed=False):
    return consensus.judge_wide(views.clean_wide(spark, sf, listed), MODELS)


@query(
    "consensus_having",
    """SELECT majority, round(avg(100e0 * top_votes / n_votes), 6) AS consensus_pct, count(*) AS n_items
       FROM cons WHERE majority IS NOT NULL GROUP BY majority HAVING count(*) >= 50
       ORDER BY avg(100e0 * top_votes / n_votes) DESC, majority LIMIT 25""",
)
def consensus_having(spark, sf):
    best = consensus.category_consensus(_consensus(spark, sf), n=25, min_items=50)
    return _rounded(best, "consensus_pct")


@query(
    "category_consensus",
    """SELECT majority, round(avg(100e0 * top_votes / 7e0), 6) AS consensus_pct, count(*) AS n_items
       FROM cons WHERE majority IS NOT NULL GROUP BY majority
       ORDER BY avg(100e0 * top_votes / 7e0) DESC, majority LIMIT 15""",
)
def category_consensus(spark, sf):
    best = consensus.category_consensus(_consensus(spark, sf), n=15, denominator=len(MODELS))
    return _rounded(best, "consensus_pct")


@query(
    "pair_join",
    """SELECT model_a, model_b, n_both, cast(n_same AS bigint) AS n_same FROM pairs WHERE model_a < model_b""",
)
def pair_join(spark, sf):
    return pairs.pair_counts(views.clean_wide(spark, sf), MODELS)


@query(
    "agreement_matrix",
    """SELECT a.model AS model_a, b.model AS model_b,
              CASE WHEN a.model = b.model THEN 100e0
                   WHEN p.n_both > 0 THEN round(100e0 * p.n_same / p.n_both, 6) ELSE 0e0 END AS agreement
       FROM family a CROSS JOIN family b
       LEFT JOIN pairs p ON p.model_a = a.model AND p.model_b = b.model""",
)
def agreement_matrix(spark, sf):
    return _rounded(pairs.agreement_matrix(views.clean_wide(spark, sf), MODELS), "agreement")


@query(
    "agreement_all_rows",
    """SELECT a.model AS model_a, b.model AS model_b, round(100e0 * coalesce(p.n_same, 0) / t.n_records, 6) AS agreement
       FROM family a CROSS JOIN family b CROSS JOIN total t
       LEFT JOIN listed_pairs p ON p.model_a = a.model AND p.model_b = b.model""",
)
def agreement_all_rows(spark, sf):
    matrix = pairs.agreement_all_rows(
        views.clean_wide(spark, sf), MODELS, views.listing(spark, sf), diagonal="coverage"
    )
    return _rounded(matrix, "agreement")


@query(
    "semi_top_labels",
    """SELECT item_id, model, prediction FROM clean WHERE prediction IN (
         SELECT prediction FROM clean WHERE prediction IS NOT NULL
         GROUP BY prediction ORDER BY count(*) DESC, prediction LIMIT 3)""",
)
def semi_top_labels(spark, sf):
    rows = views.clean_votes(spark, sf).select("item_id", "model", "prediction")
    return joins.restrict_to(rows, consensus.top_labels(rows, 3))


@query(
    "label_overlap",
    """SELECT a.prediction AS label_a, b.prediction AS label_b, count(*) AS n
       FROM top_sets a JOIN top_sets b ON a.item_id = b.item_id GROUP BY a.prediction, b.prediction""",
)
def label_overlap(spark, sf):
    rows = views.clean_votes(spark, sf).select("item_id", "prediction")
    return pairs.label_overlap(rows, consensus.top_labels(rows, 20))


@query(
    "label_freq",
    "SELECT model, prediction, count(*) AS n FROM clean WHERE prediction IS NOT NULL GROUP BY model, prediction",
)
def label_freq(spark, sf):
    return consensus.label_frequency(views.clean_votes(spark, sf))


@query(
    "top_labels",
    """SELECT prediction, count(*) AS n FROM clean WHERE prediction IS NOT NULL
       GROUP BY prediction ORDER BY n DESC, prediction LIMIT 10""",
)
def top_labels(spark, sf):
    return consensus.top_labels(views.clean_votes(spark, sf), 10)


@query(
    "label_matrix",
    "SELECT prediction, "
    + ", ".join(f"count(CASE WHEN model = '{m}' THEN 1 END) AS {m}" for m in MODELS)
    + " FROM clean WHERE prediction IS NOT NULL GROUP BY prediction",
)
def label_matrix(spark, sf):
    return consensus.label_matrix(views.clean_votes(spark, sf), MODELS)


@query("diversity", "SELECT model, count(DISTINCT prediction) AS n_labels FROM clean GROUP BY model")
def diversity(spark, sf):
    return consensus.diversity(views.clean_votes(spark, sf))


@query(
    "top_class_share",
    """SELECT model, n_labels, prediction AS top_label, n AS top_count,
              round(100e0 * n / n_records, 6) AS top_share
       FROM (SELECT model, prediction, count(*) AS n,
                    row_number() OVER (PARTITION BY model ORDER BY count(*) DESC, prediction) AS rn,
                    count(*) OVER (PARTITION BY model) AS n_labels
             FROM listed WHERE prediction IS NOT NULL GROUP BY model, prediction) CROSS JOIN total
       WHERE rn = 1""",
)
def top_class_share(spark, sf):
    rows, records = views.clean_votes(spark, sf, listed=True), views.listing(spark, sf)
    return _rounded(consensus.top_class_share(rows, records, restricted=True), "top_share")


@query("majority_vote", "SELECT item_id, majority, top_votes, n_votes, n_labels FROM cons")
def majority_vote(spark, sf):
    return consensus.consensus(views.clean_votes(spark, sf))


@query(
    "agreement_rates",
    """SELECT round(avg(CASE WHEN n_labels = 1 THEN 100e0 ELSE 0e0 END), 6) AS full_pct,
              round(avg(CASE WHEN top_votes >= 4 THEN 100e0 ELSE 0e0 END), 6) AS strong_pct,
              round(avg(CASE WHEN top_votes >= 2 THEN 100e0 ELSE 0e0 END), 6) AS majority_pct,
              round(avg(top_votes), 6) AS mean_votes
       FROM all_cons""",
)
def agreement_rates(spark, sf):
    rates = consensus.agreement_rates(_consensus(spark, sf), views.listing(spark, sf), strong=4, majority=2)
    return _rounded(rates, *rates.columns)


@query(
    "majority_dist",
    """SELECT majority, count(*) AS n FROM cons WHERE majority IS NOT NULL
       GROUP BY majority ORDER BY n DESC, majority LIMIT 15""",
)
def majority_dist(spark, sf):
    return consensus.majority_distribution(_consensus(spark, sf), 15)


@query("consensus_hist", "SELECT top_votes, count(*) AS n FROM all_cons GROUP BY top_votes")
def consensus_hist(spark, sf):
    return consensus.consensus_histogram(_consensus(spark, sf), views.listing(spark, sf))


_SHARE_BINS = "(VALUES " + ", ".join(f"('{b}')" for b in fixed.CONSENSUS_BINS) + ") AS b(bin)"
_AGREEMENT_BINS = "(VALUES " + ", ".join(f"('{b}')" for b in fixed.AGREEMENT_BINS) + ") AS b(bin)"


@query(
    "consensus_bins",
    f"""SELECT b.bin, count(c.bin) AS n FROM {_SHARE_BINS} LEFT JOIN (
          SELECT CASE WHEN s < 0.2e0 THEN '0–20%' WHEN s < 0.4e0 THEN '20–40%' WHEN s < 0.6e0 THEN '40–60%'
                      WHEN s < 0.8e0 THEN '60–80%' ELSE '80–100%' END AS bin
          FROM (SELECT CASE WHEN n_votes > 0 THEN top_votes / n_votes::double ELSE 0e0 END AS s FROM all_cons)) c
        ON b.bin = c.bin GROUP BY b.bin""",
)
def consensus_bins(spark, sf):
    return consensus.consensus_bins(_consensus(spark, sf), views.listing(spark, sf))


@query(
    "agreement_bins",
    f"""SELECT b.bin, count(c.bin) AS n FROM {_AGREEMENT_BINS} LEFT JOIN (
          SELECT CASE WHEN s <= 50e0 THEN 'Low (<50%)' WHEN s <= 99.9e0 THEN 'Majority (50-99%)'
                      ELSE 'Full (100%)' END AS bin
          FROM (SELECT 100e0 * top_votes / 7e0 AS s FROM all_cons)) c
        ON b.bin = c.bin GROUP BY b.bin""",
)
def agreement_bins(spark, sf):
    return consensus.agreement_bins(_consensus(spark, sf), views.listing(spark, sf), len(MODELS))


@query(
    "unanimity",
    """SELECT l.level, count(c.level) AS n FROM (VALUES ('Unanimous'), ('Majority'), ('Minority')) AS l(level)
       LEFT JOIN (SELECT CASE WHEN top_votes = n_votes AND n_votes > 1 THEN 'Unanimous'
                              WHEN top_votes * 2 > n_votes THEN 'Majority' ELSE 'Minority' END AS level
                  FROM cons WHERE n_votes > 0) c ON l.level = c.level GROUP BY l.level""",
)
def unanimity(spark, sf):
    return consensus.unanimity(_consensus(spark, sf))


@query(
    "unique_vote",
    """SELECT c.model, round(100e0 * count(CASE WHEN l.n = 1 THEN 1 END) / max(t.n_records), 6) AS unique_pct
       FROM listed c CROSS JOIN total t
       LEFT JOIN label_n l ON c.item_id = l.item_id AND c.prediction = l.prediction GROUP BY c.model""",
)
def unique_vote(spark, sf):
    rows, records = _judged(spark, sf, listed=True), views.listing(spark, sf)
    return _rounded(consensus.unique_vote(rows, records, restricted=True), "unique_pct")


@query(
    "divergence",
    """SELECT model, count(CASE WHEN v THEN 1 END) AS n_valid,
              round(CASE WHEN count(CASE WHEN v THEN 1 END) > 0
                THEN 100e0 * count(CASE WHEN v AND prediction <> majority THEN 1 END) / count(CASE WHEN v THEN 1 END)
                ELSE 0e0 END, 6) AS divergence_pct
       FROM (SELECT c.model, c.prediction, s.majority, c.prediction IS NOT NULL AND s.n_votes > 2 AS v
             FROM clean c JOIN cons s ON c.item_id = s.item_id) GROUP BY model""",
)
def divergence(spark, sf):
    return _rounded(consensus.divergence(_judged(spark, sf)), "divergence_pct")


_ALIGNMENT = """SELECT c.model, 100e0 * count(CASE WHEN c.prediction = s.majority THEN 1 END) / max(t.n_records) AS a
                FROM listed c JOIN cons s ON c.item_id = s.item_id CROSS JOIN total t GROUP BY c.model"""


@query("alignment", f"SELECT model, round(a, 6) AS alignment_pct FROM ({_ALIGNMENT})")
def alignment(spark, sf):
    rows, records = _judged(spark, sf, listed=True), views.listing(spark, sf)
    return _rounded(consensus.alignment(rows, records, restricted=True), "alignment_pct")


_FAMILY_LIST = "(VALUES " + ", ".join(f"('{f}')" for f in FAMILIES) + ") AS l(family)"


@query(
    "family_alignment",
    f"""SELECT l.family, round(coalesce(avg(x.a), 0e0), 6) AS alignment_pct FROM {_FAMILY_LIST}
        LEFT JOIN family f ON l.family = f.family LEFT JOIN ({_ALIGNMENT}) x ON f.model = x.model GROUP BY l.family""",
)
def family_alignment(spark, sf):
    rows, records = _judged(spark, sf, listed=True), views.listing(spark, sf)
    return _rounded(consensus.family_alignment(rows, records, FAMILY_OF, FAMILIES, restricted=True), "alignment_pct")


@query(
    "intra_family",
    f"""SELECT l.family, round(CASE WHEN count(DISTINCT f.model) = 0 THEN 0e0
                                   WHEN count(DISTINCT f.model) = 1 THEN 100e0 ELSE avg(x.a) END, 6) AS intra_pct
        FROM {_FAMILY_LIST} LEFT JOIN family f ON l.family = f.family
        LEFT JOIN (SELECT p.model_a, 100e0 * p.n_same / t.n_records AS a FROM listed_pairs p
                   JOIN family g ON p.model_a = g.model JOIN family h ON p.model_b = h.model CROSS JOIN total t
                   WHERE g.family = h.family AND p.model_a < p.model_b) x ON x.model_a = f.model
        GROUP BY l.family""",
)
def intra_family(spark, sf):
    wide, records = views.clean_wide(spark, sf), views.listing(spark, sf)
    return _rounded(pairs.intra_family(wide, records, FAMILY_OF, FAMILIES), "intra_pct")


@query(
    "error_rate",
    """SELECT model, round(100e0 * (n_records - count(prediction)) / n_records, 6) AS error_pct
       FROM listed CROSS JOIN total GROUP BY model, n_records""",
)
def error_rate(spark, sf):
    rates = consensus.error_rates(views.clean_votes(spark, sf, listed=True), views.listing(spark, sf), restricted=True)
    return _rounded(rates, "error_pct").select("model", "error_pct")


@query(
    "valid_error",
    """SELECT model, count(prediction) AS n_valid, n_records - count(prediction) AS n_error
       FROM listed CROSS JOIN total GROUP BY model, n_records""",
)
def valid_error(spark, sf):
    rates = consensus.error_rates(views.clean_votes(spark, sf, listed=True), views.listing(spark, sf), restricted=True)
    return rates.select("model", "n_valid", "n_error")


@query(
    "latency_throughput",
    """SELECT model, round(avg(latency_s), 6) AS mean_latency_s, round(1e0 / avg(latency_s), 6) AS throughput
       FROM clean WHERE prediction IS NOT NULL GROUP BY model""",
)
def latency_throughput(spark, sf):
    failed = F.col("prediction").isNull()
    return _rounded(
        timing.latency_throughput(views.clean_votes(spark, sf, latency=True), failed), "mean_latency_s", "throughput"
    )
