"""Connected components of a table of links, by label spreading and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.storage import materialize


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node of links (a, b); component is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so that the
    number of rounds grows with the logarithm of the longest path. Every join reads written tables on
    both sides, so a node with very many links is split among tasks; nothing comes to the driver but a count.
    """
    both = materialize(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).filter("node <> other").distinct(), f"{label}-links")
    labels = materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), f"{label}-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        spread = materialize(labels.join(near, "node", "left").select("node", F.least("component", "near").alias("component"), F.col("component").alias("before")), f"{label}-spread")
        roots = spread.select(F.col("node").alias("component"), F.col("component").alias("root"))
        labels = materialize(spread.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component"), "before"), f"{label}-labels")
        if labels.filter("component <> before").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
