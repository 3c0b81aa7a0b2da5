"""Connected components of a graph of links, by rounds of contraction.

Each round, every node points at its smallest neighbour if that is smaller than itself; links are
renamed to the nodes pointed at, loops and repeated links go. At least half of the nodes that still
have links lose them each round, so the rounds grow with the logarithm of the size of a component.
Each round is a stored table: nothing is collected and no lineage grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.sources import scratch


def components(links: DataFrame) -> DataFrame:
    """node, component (one node of it) for every node that has a link; links: columns a, b of one type."""
    links = links.filter("a <> b").select("a", "b")
    current = scratch.written(links.unionByName(links.selectExpr("b as a", "a as b")).distinct(), "links")
    labels = None
    while not current.isEmpty():
        parents = scratch.written(
            current.groupBy("a").agg(F.least("a", F.min("b")).alias("parent")).withColumnRenamed("a", "node"), "parents"
        )
        if labels is None:
            labels = parents.withColumnRenamed("parent", "component")
        else:
            moved = parents.select(F.col("node").alias("component"), "parent")
            labels = scratch.written(
                labels.join(moved, "component", "left").select(
                    "node", F.coalesce("parent", "component").alias("component")
                ),
                "labels",
            )
        a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        renamed = current.join(a, "a").join(b, "b").filter("pa <> pb").select(
            F.col("pa").alias("a"), F.col("pb").alias("b")
        )
        current = scratch.written(renamed.distinct(), "links")
    if labels is None:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
