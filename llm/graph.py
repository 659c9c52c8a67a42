"""Connected components of an edge list, by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import discard, materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: columns a, b (long).  node, root: the smallest node of its component, for every node that has an edge to another.  Edges with
    a null end and loops are ignored, repeated ones count once; no edges give an empty table.

    A node's neighbours are never gathered: each round takes their minimum (combined before the shuffle) and joins it back.  The
    minima are written first: then both sides of the join are plain shuffles, and Spark splits those of a node with very many
    neighbours.  What a round wrote goes when the next one's edges are there.  Rounds number as the logarithm of the longest path, each
    moves at most twice the edges; a graph that has not settled after `most_rounds` fails."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        smaller = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "smaller")
        small = large.join(smaller, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(smaller.select("a", F.col("m").alias("b"))).distinct()
        old, edges = edges, materialize(small, "edges")
        for done in (old, least, large, smaller):
            discard(done)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("the components did not settle")
