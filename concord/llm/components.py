"""Connected components of a graph of links, by shuffles of labels alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node and label (smallest node of its component) for links (a, b).

    Each round gives a node the smallest label among its neighbours and then
    the label of that label, so chains shorten by half or more; labels are
    written between rounds. A node with very many links costs no more than
    its links: minima are formed before the shuffle.
    """
    links = links.filter("a <> b").select("a", "b")
    links = written(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = links.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        found = labels.join(near, F.col("node") == F.col("a"), "left")
        found = found.select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        further = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        found = written(found.join(further, "next", "left").select("node", "label", F.least("next", F.coalesce("jump", "next")).alias("next")))
        labels = found.select("node", F.col("next").alias("label"))
        if found.filter("next <> label").isEmpty():
            return labels
