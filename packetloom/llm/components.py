"""Connected components of a graph given as pairs, by contraction to a random smaller neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.session import durable


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a, b``); nodes of a component share the root.

    In each round a node moves to the neighbour (or itself) with the smallest hash, which takes away a
    constant share of the nodes of any graph, long chains included; the hashes change from round to round.
    """
    edges = durable(links.select("a", "b").filter("a <> b").distinct())
    moved = None
    round_no = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(round_no)).alias("h"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(F.xxhash64("a", F.lit(round_no)).alias("h"), F.col("a").alias("to"))
        step = durable(near.select(F.col("a").alias("node"), F.least("m", own)["to"].alias("root")))
        one, two = (step.select(F.col("node").alias(k), F.col("root").alias(f"_{k}")) for k in "ab")
        edges = durable(edges.join(one, "a").join(two, "b").select(
            F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).filter("a <> b").distinct())
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            moved = durable(moved.join(later, "root", "left").select("node", F.coalesce("_next", "root").alias("root")))
        round_no += 1
    if moved is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return moved
