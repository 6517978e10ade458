"""Connected components by label minima and pointer jumping, in joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def thinned(links: DataFrame) -> DataFrame:
    """Fewer links (a, b) with the components of links(a, b).

    A node keeps the link to the least of its lesser neighbours; its other lesser neighbours are linked with that one in
    its place, where the links of many nodes fall together. A round makes no more links than it takes; rounds go on while
    they halve the links, so a dense group of nodes, each linked to many, is left with a few links a node.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")
    links = cut(links.distinct())
    n = links.count()
    while True:
        least = cut(links.groupBy("b").agg(F.min("a").alias("least")))
        moved = links.join(least, "b").select(F.col("least").alias("a"), F.when(F.col("a") == F.col("least"), F.col("b")).otherwise(F.col("a")).alias("b"))
        links = cut(moved.distinct())
        before, n = n, links.count()
        if 2 * n >= before:
            return links


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for the nodes of links(a, b).

    Each round takes the least label among neighbours, then the label of the label, so a chain of n links needs about
    log n rounds. Both sides of every join are read from a checkpoint, so that Spark can split skewed partitions.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("peer")).union(links.select("b", "a"))
    both = cut(both.filter("node <> peer").distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.min("peer"), F.first("node")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("peer"), "label"), "peer").groupBy("node").agg(F.min("label").alias("near"))
        step = cut(labels.join(near, "node", "left").select("node", F.least("label", "near").alias("next"), "label"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        step = cut(step.join(jump, "next", "left").select("node", F.least("next", "far").alias("next"), "label"))
        moved = step.filter("next <> label").limit(1).count()
        labels = step.select("node", F.col("next").alias("label"))
        if not moved:
            return labels
