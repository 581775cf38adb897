"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.session import checkpointed


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) of every node of edges (a, b); the component is its least node.

    Each round only aggregates minima per node (combined before the shuffle) and joins them back, so
    a hub is no problem; lineage is cut by a checkpoint per round. Self-loops keep a node in the result. The rounds needed grow with the logarithm of the
    longest path; a RuntimeError is raised rather than a wrong result returned if max_rounds do not settle it.
    """
    pairs = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = checkpointed(pairs)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    pairs = pairs.where(F.col("a") != F.col("b"))
    state = None
    for _ in range(max_rounds):
        both = pairs.select("a", "b").union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("e"))
        pairs = checkpointed(small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where(F.col("a") != F.col("b")).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(pairs.withColumnRenamed("a", "node").withColumnRenamed("b", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
