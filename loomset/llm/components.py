"""Connected components by contraction, every step a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomset.runtime import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of ``edges`` (a, b): the least node of its component.

    Each round, every node points to its least neighbour, or itself; pointers are followed one
    step further, both ends of every edge are replaced by what they point to, and edges that
    have become loops or repeats go. Nodes should be hashes, so that a long chain has its
    minima everywhere and shrinks by a factor each round. Neighbour minima are combined before the shuffle, so that a node
    with a third of all edges costs one row per task; the joins look up one row per node and
    are split by Spark where one node has very many edges. Edges with a NULL end are ignored.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = materialise(edges, "edges")
    labels = materialise(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        least = materialise(least, "pointers")
        further = least.select(F.col("a").alias("p"), F.col("p").alias("q"))
        jump = materialise(least.join(further, "p").select("a", F.col("q").alias("p")), "pointers")
        to = lambda old, new: jump.select(F.col("a").alias(old), F.col("p").alias(new))
        moved = edges.join(to("a", "x"), "a").select("x", "b").join(to("b", "y"), "b")
        edges = moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b")
        edges = materialise(edges.distinct(), "edges")
        labels = labels.join(to("label", "next"), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        labels = materialise(labels, "labels")
    return labels
