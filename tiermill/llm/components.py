"""Connected components by contraction, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (a, b); nodes of a component share a label.

    Each round every node points at the smallest of itself and its neighbours and the edges are rewritten to the
    nodes pointed at; the rounds' pointers are then chained.  With node ids that are hashes a constant share of the
    nodes goes in every round, so the number of rounds grows with the logarithm of the graph.  Each step is an aggregation
    with map-side partial minima or a join on the node, so a node with very many links is spread out.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("next")))
        point = stored(both.groupBy("node").agg(F.min("next").alias("next"))
                                .select("node", F.least("node", "next").alias("to")))
        if labels is None:
            labels = point.select("node", F.col("to").alias("label"))
        else:
            then = point.select(F.col("node").alias("label"), "to")
            labels = labels.join(then, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        a = point.select(F.col("node").alias("a"), F.col("to").alias("pa"))
        b = point.select(F.col("node").alias("b"), F.col("to").alias("pb"))
        edges = stored(edges.join(a, "a").join(b, "b").where("pa <> pb")
                                 .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    return stored(labels)
