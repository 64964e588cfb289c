"""Connected components of a graph given by its links, worked out on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node it is connected with) for every node of `links` (a, b).

    Every round a node takes the smallest label among its neighbours', then the label of its label; the
    number of rounds grows with the logarithm of the longest path. Rounds are stored. A node with very
    many links is pre-aggregated before the shuffle, and its label joined, not collected.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        further = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = step.join(further, "label").select("node", "old", F.least("label", "root").alias("label"))
        jumped = stored(jumped, "labels")
        changed = jumped.filter("old <> label").limit(1).count()
        labels = jumped.select("node", "label")
        if changed == 0:
            return labels
