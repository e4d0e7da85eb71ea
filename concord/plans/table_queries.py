"""Sources, cleaning, joins, sets and sampling over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions import cleaning, fixed_values, paths, rules
from concord.operators import consensus, joins, ordering, runs, sampling, votes
from concord.plans import views
from concord.plans.registry import query
from concord.plans.views import MODELS
from concord.sources import files

PAGE_EXTENSIONS = [".html", ".htm"]


@query(
    "ext_filter",
    r"""SELECT page_id, url, lower(regexp_extract(url, '[^/\\.][^/\\]*?(\.[^./\\]+)$', 1)) AS ext FROM pages
        WHERE lower(regexp_extract(url, '[^/\\.][^/\\]*?(\.[^./\\]+)$', 1)) IN ('.html', '.htm')""",
)
def ext_filter(spark, sf):
    pages = views.table(spark, sf, "pages").select("page_id", "url")
    return files.with_extension(pages, "url", PAGE_EXTENSIONS)


@query(
    "folder_label",
    r"""SELECT page_id, label, dense_rank() OVER (ORDER BY label) - 1 AS class_index FROM (
          SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^/]+)/', 1) AS label FROM pages)
        WHERE label <> ''""",
)
def folder_label(spark, sf):
    pages = views.table(spark, sf, "pages").select("page_id", "url")
    below_host = F.regexp_replace("url", "^[a-z]+://[^/]+/", "/data/")
    return files.with_folder_label(pages, below_host, "/data").select("page_id", "label", "class_index")


@query(
    "task_grid",
    """SELECT d.dataset, m.model FROM (SELECT DISTINCT p_type AS dataset FROM part) d
       CROSS JOIN (SELECT DISTINCT model FROM family) m
       WHERE d.dataset IN (SELECT p.p_type FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey)""",
)
def task_grid(spark, sf):
    parts = views.table(spark, sf, "part")
    lines = views.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    available = parts.join(lines, "p_partkey", "left_semi").select(F.col("p_type").alias("dataset")).distinct()
    return joins.task_grid(parts.select(F.col("p_type").alias("dataset")).distinct(), MODELS, available)


@query(
    "upsert_model",
    """SELECT item_id, model, prediction FROM (
         SELECT item_id, model, raw_prediction AS prediction FROM votes WHERE model <> 'm3'
         UNION ALL SELECT item_id, model, lower(raw_prediction) FROM votes WHERE model = 'm3')
       WHERE item_id IN (SELECT o_orderkey FROM orders)""",
)
def upsert_model(spark, sf):
    raw = views.raw_votes(spark, sf, listed=True)
    stored = raw.select("item_id", "model", F.col("raw_prediction").alias("prediction"))
    fresh = stored.filter("model = 'm3'").select("item_id", F.lower("prediction").alias("prediction"))
    return joins.upsert_model(stored, fresh, "m3", views.listing(spark, sf), restricted=True)


_UPSERTED = """SELECT item_id, model, prediction FROM clean WHERE model <> 'm3'
               UNION ALL SELECT item_id, model, lower(prediction) FROM clean WHERE model = 'm3' AND item_id % 3 <> 0"""


@query(
    "upsert_consensus",
    f"""SELECT item_id, max(CASE WHEN rn = 1 THEN prediction END) AS majority, max(n) AS top_votes,
              cast(sum(n) AS bigint) AS n_votes, count(prediction) AS n_labels
       FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, prediction) AS rn
             FROM (SELECT item_id, prediction, count(prediction) AS n FROM ({_UPSERTED}) GROUP BY item_id, prediction))
       GROUP BY item_id""",
)
def upsert_consensus(spark, sf):
    """The consensus after one model's new predictions, from the consensus and the counts before them."""
    votes = views.clean_votes(spark, sf).select("item_id", "model", "prediction")
    counts = consensus.label_counts(votes)
    before = consensus.consensus_of_counts(counts)
    old = votes.filter("model = 'm3'")
    new = old.filter("item_id % 3 <> 0").select("item_id", F.lower("prediction").alias("prediction"))
    return consensus.updated_consensus(before, counts, consensus.changed_counts(old, new))


@query(
    "report_rows",
    r"""SELECT concat(model, ' & ', """
    + ", ' & ', ".join(
        f"coalesce(printf('%.2f', avg(CASE WHEN dataset = '{d}' THEN accuracy END)), 'NaN')" for d in views.DATASETS
    )
    + r""", ' \\') AS line FROM runs GROUP BY model""",
)
def report_rows(spark, sf):
    table = runs.metric_pivot(views.runs(spark, sf), "accuracy", views.DATASETS, "mean_accuracy")
    return runs.table_rows(table, ["model"], views.DATASETS)


@query("clean_errors", "SELECT item_id, model, prediction FROM clean")
def clean_errors(spark, sf):
    return views.clean_votes(spark, sf).select("item_id", "model", "prediction")


@query(
    "clean_exact",
    "SELECT item_id, model, nullif(raw_prediction, 'Error_Processing') AS prediction FROM votes",
)
def clean_exact(spark, sf):
    raw = F.col("raw_prediction")
    return views.raw_votes(spark, sf).select(
        "item_id", "model", cleaning.null_exact(raw, fixed_values.ERROR_PROCESSING).alias("prediction")
    )


@query("drop_null_rows", "SELECT item_id, model, prediction FROM clean WHERE prediction IS NOT NULL")
def drop_null_rows(spark, sf):
    return views.clean_votes(spark, sf).select("item_id", "model", "prediction").dropna(subset=["prediction"])


@query(
    "live_models",
    """SELECT item_id, model, prediction FROM clean
       WHERE model IN (SELECT model FROM clean GROUP BY model HAVING count(prediction) > 0)""",
)
def live_models(spark, sf):
    return votes.live_votes(views.clean_votes(spark, sf).select("item_id", "model", "prediction"))


@query(
    "filter_in",
    """SELECT dataset, model, run, accuracy FROM runs
       WHERE model IN ('m1', 'm2', 'm3', 'm4', 'm5', 'm6') AND dataset IN ('ECONOMY', 'PROMO', 'SMALL')
         AND run <> 'F'""",
)
def filter_in(spark, sf):
    kept = F.col("model").isin(MODELS[:6]) & F.col("dataset").isin("ECONOMY", "PROMO", "SMALL")
    return views.runs(spark, sf).filter(kept & (F.col("run") != "F")).select("dataset", "model", "run", "accuracy")


@query("select_pattern", "SELECT item_id, " + ", ".join(f"{m}_time" for m in MODELS) + " FROM wide")
def select_pattern(spark, sf):
    return votes.select_like(views.votes_wide(spark, sf, latency=True), "item_id", suffix="_time")


@query("rename_strip", "SELECT item_id, " + ", ".join(f"{m}_time AS {m}" for m in MODELS) + " FROM wide")
def rename_strip(spark, sf):
    times = votes.select_like(views.votes_wide(spark, sf, latency=True), "item_id", suffix="_time")
    padded = times.withColumnsRenamed({c: f" {c}  " for c in times.columns})
    return votes.strip_names(padded, suffix="_time")


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8195) || chr(12288)"


@query(
    "trim_text",
    f"""SELECT doc_id, trim(source, {_BLANKS}) AS source,
               trim(concat(chr(9), chr(160), text, chr(12288), chr(10)), {_BLANKS}) AS text FROM documents""",
)
def trim_text(spark, sf):
    documents = views.table(spark, sf, "documents")
    padded = F.concat(F.lit("\t "), F.col("text"), F.lit("　\n"))
    return documents.select(
        "doc_id", cleaning.strip_text(F.col("source")).alias("source"), cleaning.strip_text(padded).alias("text")
    )


@query(
    "safe_cast",
    r"""SELECT page_id, raw, try_cast(CASE WHEN raw <> '—' THEN raw END AS double) AS number FROM (
          SELECT page_id, CASE WHEN url LIKE '%#top' THEN '—' ELSE regexp_extract(url, '([^/]*)/?$', 1) END AS raw
          FROM pages)""",
)
def safe_cast(spark, sf):
    last = F.regexp_extract("url", "([^/]*)/?$", 1)
    pages = views.table(spark, sf, "pages").select(
        "page_id", F.when(F.col("url").endswith("#top"), F.lit("—")).otherwise(last).alias("raw")
    )
    return pages.withColumn("number", cleaning.to_number(F.col("raw")))


@query(
    "guarded_ratio",
    """SELECT event_id,
              round(CASE WHEN k > 0 THEN value / k ELSE 0e0 END, 6) AS ratio,
              round(value / (k + 1e-6), 6) AS eps_ratio,
              round(value * 1000e0, 6) AS millis,
              round(CASE WHEN value > 0 THEN 1000e0 / value ELSE 0e0 END, 6) AS per_second,
              round(event_id / 1e6, 6) AS millions,
              round(event_id / 1048576e0, 6) AS mebibytes
       FROM (SELECT *, cast(json_extract_string(props, '$.k') AS bigint) % 10 AS k FROM events)""",
)
def guarded_ratio(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint") % 10
    events = views.table(spark, sf, "events").select("event_id", "value", k.alias("k"))
    value, k = F.col("value"), F.col("k")
    cells = {
        "ratio": cleaning.safe_ratio(value, k),
        "eps_ratio": cleaning.eps_ratio(value, k),
        "millis": cleaning.to_millis(value),
        "per_second": cleaning.per_second(value),
        "millions": cleaning.to_millions(F.col("event_id")),
        "mebibytes": cleaning.to_mebibytes(F.col("event_id")),
    }
    return events.select("event_id", *[F.round(c, 6).alias(name) for name, c in cells.items()])


@query(
    "mean_std_text",
    """SELECT event_type AS model, printf('%.2f ± %.2f', avg(value), stddev_samp(value)) AS latency
       FROM events GROUP BY event_type""",
)
def mean_std_text(spark, sf):
    events = views.table(spark, sf, "events").groupBy(F.col("event_type").alias("model"))
    text = cleaning.mean_std_text(F.avg("value"), F.stddev_samp("value"))
    return events.agg(text.alias("latency"))


@query(
    "safe_name",
    r"""SELECT p_partkey, concat(printf('%02d', p_partkey), '_', substring(
               regexp_replace(concat(p_name, '/', p_brand), '[^\p{L}\p{N} _-]', '_', 'g'), 1, 60)) AS name,
               substring(p_name, 1, 25) AS short
        FROM part""",
)
def safe_name(spark, sf):
    parts = views.table(spark, sf, "part")
    title = F.concat("p_name", F.lit("/"), "p_brand")
    return parts.select(
        "p_partkey",
        cleaning.safe_name(F.col("p_partkey"), title).alias("name"),
        cleaning.short_label(F.col("p_name")).alias("short"),
    )


@query(
    "path_label",
    r"""SELECT page_id, CASE WHEN len(parts) >= 2 THEN parts[-2] ELSE 'Unknown' END AS ground_truth
        FROM (SELECT page_id, string_split(replace(url, '\', '/'), '/') AS parts FROM pages)""",
)
def path_label(spark, sf):
    pages = views.table(spark, sf, "pages").select("page_id", F.col("url").alias("filepath"))
    return files.with_ground_truth(pages).select("page_id", "ground_truth")


@query(
    "map_lookup",
    """SELECT r.dataset, r.model, r.run, w.w AS watts, coalesce(f.family, 'Other') AS family,
              coalesce(w.w, 0e0) AS watts_or_zero
       FROM runs r LEFT JOIN watts w ON r.model = w.model LEFT JOIN family f ON r.model = f.model""",
)
def map_lookup(spark, sf):
    model = F.col("model")
    return views.runs(spark, sf).select(
        "dataset",
        "model",
        "run",
        rules.lookup(model, views.WATTS).alias("watts"),
        rules.lookup(model, views.FAMILY_OF, "Other").alias("family"),
        rules.lookup(model, views.WATTS, 0.0).alias("watts_or_zero"),
    )


PART_ALIASES = {
    "small-ring": "ring.s",
    "small_ring": "ring.never",
    "red_widget": "widget.r",
    "bluebolt": "bolt.b",
    "hot gear": "gear.h",
}


@query(
    "norm_lookup",
    """SELECT p_partkey, CASE
         WHEN k = 'small-ring' THEN 'ring.s' WHEN k = 'small_ring' THEN 'ring.never'
         WHEN k = 'red_widget' THEN 'widget.r' WHEN k = 'bluebolt' THEN 'bolt.b' WHEN k = 'hot gear' THEN 'gear.h'
         WHEN f = 'smallring' THEN 'ring.s' WHEN f = 'redwidget' THEN 'widget.r'
         WHEN f = 'bluebolt' THEN 'bolt.b' WHEN f = 'hot gear' THEN 'gear.h' ELSE k END AS alias
       FROM (SELECT p_partkey, lower(name) AS k, replace(replace(lower(name), '-', ''), '_', '') AS f
             FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN upper(replace(p_name, ' ', '-'))
                                                     WHEN 1 THEN replace(p_name, ' ', '_') ELSE p_name END AS name
                   FROM part))""",
)
def norm_lookup(spark, sf):
    size = F.col("p_size") % 3
    name = (
        F.when(size == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))))
        .when(size == 1, F.replace("p_name", F.lit(" "), F.lit("_")))
        .otherwise(F.col("p_name"))
    )
    parts = views.table(spark, sf, "part").select("p_partkey", name.alias("name"))
    return parts.select("p_partkey", rules.lookup_normalised(F.col("name"), PART_ALIASES).alias("alias"))


PART_FAMILIES = {"Hot": ["hot", "red"], "Round": ["ring", "gear", "rod"], "Flat": ["plate", "hot"], "Large": ["large"]}


@query(
    "keyword_family",
    """SELECT p_partkey, CASE WHEN p_name LIKE '%hot%' OR p_name LIKE '%red%' THEN 'Hot'
         WHEN p_name LIKE '%ring%' OR p_name LIKE '%gear%' OR p_name LIKE '%rod%' THEN 'Round'
         WHEN p_name LIKE '%plate%' OR p_name LIKE '%hot%' THEN 'Flat'
         WHEN p_name LIKE '%large%' THEN 'Large' ELSE 'Other' END AS family
       FROM part""",
)
def keyword_family(spark, sf):
    parts = views.table(spark, sf, "part").select("p_partkey", F.initcap("p_name").alias("name"))
    return parts.select("p_partkey", rules.keyword_family(F.col("name"), PART_FAMILIES).alias("family"))


EVENT_RULES = [("signup", "person"), ("view", "unknown"), ("9", "nines"), ("3", "threes")]


@query(
    "json_rule",
    """SELECT event_id, CASE WHEN t LIKE '%signup%' THEN 'person' WHEN t LIKE '%view%' THEN 'unknown'
         WHEN k LIKE '%9%' THEN 'nines' WHEN k LIKE '%3%' THEN 'threes' ELSE 'unknown' END AS kind
       FROM (SELECT event_id, lower(event_type) AS t, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events)""",
)
def json_rule(spark, sf):
    kind = rules.rule_label(F.col("event_type"), F.col("props"), EVENT_RULES, ["$.k", "$.tags[0]"])
    return views.table(spark, sf, "events").select("event_id", kind.alias("kind"))


@query(
    "unpivot_votes",
    " UNION ALL ".join(f"SELECT item_id, '{m}' AS model, {m} AS prediction FROM wide" for m in MODELS),
)
def unpivot_votes(spark, sf):
    return votes.unpivot(views.votes_wide(spark, sf), MODELS)


@query("pivot_votes", "SELECT item_id, " + ", ".join(MODELS + [f"{m}_time" for m in MODELS]) + " FROM wide")
def pivot_votes(spark, sf):
    return votes.widen(views.raw_votes(spark, sf, latency=True), MODELS, {"raw_prediction": "", "latency_s": "_time"})


@query(
    "left_merge",
    """SELECT o.o_orderkey AS item_id, c.prediction, c.latency_s FROM orders o
       LEFT JOIN (SELECT * FROM clean WHERE model = 'm1') c ON o.o_orderkey = c.item_id""",
)
def left_merge(spark, sf):
    one = views.clean_votes(spark, sf, latency=True).filter("model = 'm1'").select("item_id", "prediction", "latency_s")
    return joins.merge_onto(views.listing(spark, sf), one)


@query(
    "priority_fill",
    """SELECT dataset, model, accuracy, 'measured' AS origin FROM runs WHERE run = 'F' AND accuracy > 50
       UNION ALL SELECT dataset, model, accuracy, 'default' FROM runs r WHERE run = 'O' AND NOT EXISTS (
         SELECT 1 FROM runs f WHERE f.run = 'F' AND f.accuracy > 50 AND f.dataset = r.dataset AND f.model = r.model)""",
)
def priority_fill(spark, sf):
    both = views.runs(spark, sf).select("dataset", "model", "run", "accuracy")
    measured = both.filter("run = 'F' and accuracy > 50").drop("run").withColumn("origin", F.lit("measured"))
    default = both.filter("run = 'O'").drop("run").withColumn("origin", F.lit("default"))
    return joins.priority_fill(measured, default, ["dataset", "model"])


WANTED_MODELS = ["m7", "m3", "m9", "m1", "m5"]
_WANTED_SQL = "(VALUES " + ", ".join(f"({i}, '{m}')" for i, m in enumerate(WANTED_MODELS)) + ") AS w(position, model)"


@query(
    "reindex_list",
    f"""SELECT cast(w.position AS bigint) AS position, w.model, round(avg(r.accuracy), 8) AS accuracy
        FROM {_WANTED_SQL} LEFT JOIN runs r ON w.model = r.model GROUP BY w.position, w.model""",
)
def reindex_list(spark, sf):
    means = runs.run_means(views.runs(spark, sf), ["accuracy"], ["model"], digits=8)
    return joins.reindex(means, "model", WANTED_MODELS)


@query(
    "intersect_names",
    f"""SELECT cast(w.position AS bigint) AS position, w.model FROM {_WANTED_SQL}
        WHERE w.model IN (SELECT concat('m', cast(l_linenumber AS varchar(10))) FROM lineitem)""",
)
def intersect_names(spark, sf):
    lines = views.table(spark, sf, "lineitem")
    names = lines.select(F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"))
    return joins.intersect_names(names, "model", WANTED_MODELS)


@query(
    "dedupe_first",
    """SELECT dataset, model, run, accuracy FROM (
         SELECT *, row_number() OVER (PARTITION BY dataset, model ORDER BY CASE run WHEN 'O' THEN 0 ELSE 1 END) AS rn
         FROM runs) WHERE rn = 1""",
)
def dedupe_first(spark, sf):
    priority = F.when(F.col("run") == "O", 0).otherwise(1)
    rows = views.runs(spark, sf).select("dataset", "model", "run", "accuracy")
    return ordering.keep_first(rows, ["dataset", "model"], [priority])


@query("multi_sort", "SELECT dataset, model, run, accuracy, latency_ms FROM runs ORDER BY 1, 4 DESC, 5, 2, 3")
def multi_sort(spark, sf):
    rows = views.runs(spark, sf).select("dataset", "model", "run", "accuracy", "latency_ms")
    return rows.orderBy("dataset", F.desc("accuracy"), "latency_ms", "model", "run")


@query(
    "union_runs",
    """SELECT dataset, model, run, accuracy, NULL AS peak FROM runs
       UNION ALL SELECT NULL, event_type, NULL, NULL, max(value) FROM events GROUP BY event_type""",
)
def union_runs(spark, sf):
    measured = views.runs(spark, sf).select("dataset", "model", "run", "accuracy")
    gauges = views.power(spark, sf).groupBy("model").agg(F.max("power_w").alias("peak"))
    return joins.union_rows(measured, gauges)


@query(
    "label_universe",
    """SELECT truth AS label FROM epoch_log UNION SELECT prediction FROM epoch_log""",
)
def label_universe(spark, sf):
    return joins.label_universe(views.epoch_log(spark, sf), "truth", "prediction")


_HASHED = "(SELECT *, md5(concat(cast(doc_id AS varchar(20)), ':42')) AS h FROM documents)"


@query(
    "split_80_20",
    f"""SELECT doc_id, lang, CASE WHEN row_number() OVER (ORDER BY h, doc_id) <= floor(0.8e0 * count(*) OVER ())
                             THEN 'train' ELSE 'test' END AS subset FROM {_HASHED}""",
)
def split_80_20(spark, sf):
    return sampling.split(views.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")


@query("subsample", f"SELECT doc_id, lang, n_chars FROM {_HASHED} ORDER BY h, doc_id LIMIT 400")
def subsample(spark, sf):
    return sampling.sample(views.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 400)
