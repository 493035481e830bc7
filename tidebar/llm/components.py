"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a long, b long) -> (node, component): the smallest id reachable from each id that has a link.

    Each round every node takes the least label around it, then the label of its label, so long chains halve. Labels are written to the shared
    folder each round. Minima are taken before rows move, so a node with very many links costs one row per task; joins are plain
    sort-merge joins that Spark can split where a label is common.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    for _ in range(most_rounds):
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("around"))
        near = materialize(labels.join(around, "node").select("node", F.col("component").alias("was"), F.least("component", "around").alias("component")), "labels")
        if not near.where("component <> was").limit(1).count():
            return labels
        of = near.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = materialize(near.join(of, "component", "left").select("node", F.coalesce(F.least("next", "component"), "component").alias("component")), "labels")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
