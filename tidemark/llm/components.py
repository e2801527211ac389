"""Connected components by repeated contraction, for graphs of links between documents or vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import skew_join, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: the smallest node that links reach.

    Every round hooks each node to the neighbour with the least random rank (a hash, so long ordered chains shrink too),
    rewrites the edges to the hooks and drops those inside a cluster; the number of nodes falls by a constant factor at
    least.  Neighbours are reduced by a partially aggregated minimum and all joins are ones that adaptive execution can
    split, so a hub with a third of all links is no single task's.  Each round is written to the shared folder; the loop
    ends when no edges are left.  Nodes without edges are the caller's.
    """
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c).alias("n"))
    rest = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    label = None
    while not rest.isEmpty():
        both = rest.select("a", "b").unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("least"))
        hook = stored(least.select("a", F.when(rank("a") < F.col("least"), F.col("a")).otherwise(F.col("least.n")).alias("h")), "hooks")
        hooked = hook.select(F.col("a").alias("c"), "h")
        if label is None:
            label = stored(hook.select(F.col("a").alias("node"), F.col("h").alias("c")), "labels")
        else:
            label = stored(skew_join(label, hooked, "c", "left").select("node", F.coalesce("h", "c").alias("c")), "labels")
        moved = skew_join(rest.withColumnRenamed("a", "c"), hooked, "c").select(F.col("h").alias("a"), F.col("b").alias("c"))
        moved = skew_join(moved, hooked, "c").select("a", F.col("h").alias("b"))
        rest = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    least = label.groupBy("c").agg(F.min("node").alias("component"))
    return skew_join(label, least, "c").select("node", "component")
