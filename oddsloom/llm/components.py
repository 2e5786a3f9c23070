"""Connected components of a graph in a DataFrame, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for the nodes of ``links`` (a, b).

    Each round gives a node the least label among its neighbours, then follows that label to its own
    label, so long chains shrink geometrically.  Every round is written to the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "links")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = stored(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "nearer")
        ahead = nearer.select(F.col("node").alias("label"), F.col("label").alias("ahead"))
        labels = stored(nearer.join(ahead, "label", "left").select("node", "was", F.coalesce("ahead", "label").alias("label")), "labels")
        if labels.where("label <> was").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
