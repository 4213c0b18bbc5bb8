"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every node of ``edges`` (columns a, b).

    Every round each node links its larger neighbours, then its smaller ones, to the smallest neighbour; the graph
    turns into stars in a number of rounds that grows with the logarithm of its size. Minima and distinct edges are
    merged before each shuffle. Nodes must not be null; no edges give an empty result.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        # Large star: neighbours larger than a node hang on its minimum.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large.filter("a != b"))
        # Small star: a node's smaller neighbours and itself hang on the smallest of them.
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        now = materialize(small.filter("a != b").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
