"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(a, b) edges to (node, label): each node that has an edge, with its component's smallest node.

    Each step relinks a node's neighbours to their minimum, so depth falls
    logarithmically; the loop ends when the edges are stars. Minima are written
    before they are joined, so that Spark can split the partition of a node that
    holds many of the edges. Self-loops and rows with a null end are ignored.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label"))
    state = scratch.keep(pairs.distinct(), f"{name}-edges-0")
    turn = 0
    while True:
        sources = state.groupBy("node").agg(F.count("*").alias("n"))
        forks = sources.where("n > 1").select("node").limit(1)
        chains = state.select(F.col("label").alias("node")).join(sources, "node", "left_semi").select("node").limit(1)
        if forks.unionAll(chains).isEmpty():
            return state
        turn += 1
        both = state.unionByName(state.select(F.col("label").alias("node"), F.col("node").alias("label")))
        low = scratch.keep(both.groupBy("node").agg(F.min("label").alias("low")).withColumn("low", F.least("low", "node")), f"{name}-low-{turn}")
        large = both.where("label > node").join(low, "node").select(F.col("label").alias("node"), F.col("low").alias("label")).distinct()
        large = scratch.keep(large, f"{name}-large-{turn}")
        low = scratch.keep(large.groupBy("node").agg(F.min("label").alias("low")), f"{name}-small-{turn}")
        moved = large.join(low, "node").where("label <> low").select(F.col("label").alias("node"), F.col("low").alias("label"))
        following = scratch.keep(moved.unionByName(low.withColumnRenamed("low", "label")).distinct(), f"{name}-edges-{turn}")
        scratch.drop(f"{name}-edges-{turn - 1}", f"{name}-low-{turn}", f"{name}-large-{turn}", f"{name}-small-{turn}")
        state = following
