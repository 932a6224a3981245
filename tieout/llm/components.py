"""Connected components of a large edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


#: A node is a hub if it is an end of over one in so many of the edges' ends, so there are fewer hubs than this.
HUBS, LEAST_HUB = 1024, 4096


def with_least(edges: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """edges(u, ..) with m from least(u, m, n), n being how often u comes in edges: that of hubs is broadcast, so that no task gets all edges of one."""
    hub = F.col("n") > max(LEAST_HUB, ends // HUBS)
    hubs = F.broadcast(least.where(hub).select("u", F.col("m").alias("_m")))
    marked = edges.join(hubs, "u", "left")
    rest = marked.where("_m is null").drop("_m").join(least.where(~hub).select("u", "m"), "u")
    return marked.where("_m is not null").withColumnRenamed("_m", "m").unionByName(rest)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (node long, component long), the component being its smallest node.

    Large-star then small-star rounds: each node's neighbours are hooked to the smallest of them,
    until the edges are stars around the smallest nodes. The rounds needed grow with the logarithm
    of the number of nodes. Each is a few grouped minima and joins (no neighbour list is gathered, and
    hubs are joined by broadcast), and ends in a checkpoint. Loops, null ends and repeated edges are
    allowed and ignored; nodes without an edge to another node are not in the result.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = checkpointed(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = with_least(both.where("v > u"), least, 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = checkpointed(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = with_least(large, least, 2 * now[0]).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"no stars after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
