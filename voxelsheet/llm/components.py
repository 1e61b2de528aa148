"""Connected components of a table of links, without bringing links to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .joins import heavy_keys, spread_join


def components(links: DataFrame) -> DataFrame:
    """node, label for every node with a link (columns a, b); the label is the component's smallest node.

    Each round takes the smallest label among the neighbours and then the
    label of the label, so long chains halve from round to round. Every
    aggregate is combined ahead of its shuffle; only a count comes to the driver.
    Nodes with very many links, and labels of very many nodes, meet by broadcast.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.filter("a != b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = materialize(labels, "labels")
    hubs = heavy_keys(both, "b")
    while True:
        near = spread_join(both, labels.withColumnRenamed("node", "b"), "b", hubs).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        common = heavy_keys(labels, "label")
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        if common is not None:
            lower = materialize(lower, "lower")
        jumped = spread_join(lower, above, "label", common).select("node", "old", F.least("label", "top").alias("label"))
        moved = materialize(jumped, "labels")
        labels = moved.select("node", "label")
        if moved.filter("old != label").isEmpty():
            return labels
