"""Strongly connected components of large graphs: chains at once by doubling, the rest by least labels forward and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import written

#: Passes that drop nodes without a way in or out, before chains are looked for again.
TRIMS = 3


def _chains(e: DataFrame) -> DataFrame:
    """(v, before, after): nodes with one edge in and one out."""
    ins = e.groupBy(F.col("t").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.first("s").alias("before")).where("n = 1").drop("n")
    outs = e.groupBy(F.col("s").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.first("t").alias("after")).where("n = 1").drop("n")
    return written(ins.join(outs, "v"))


def _ends(chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((v, before, after): the nodes outside of all chains between which v's chain lies, (v, least): nodes whose chain has no end).

    A pointer from each node goes one step in either direction, then to where the pointer of its aim goes,
    so that it is at the end of its chain after as many rounds as the chain's length has binary digits.
    """
    one = lambda c, forward: chains.select("v", F.lit(forward).alias("on"), F.col(c).alias("to"), F.lit(False).alias("ended"), F.least("v", c).alias("least"))
    at = written(one("before", False).unionByName(one("after", True)))
    n, reach = chains.count(), 1
    while True:
        aim = at.select(F.col("on").alias("_on"), F.col("v").alias("to"), F.col("to").alias("_to"), F.col("ended").alias("_ended"), F.col("least").alias("_least"))
        met = at.where("not ended").join(aim, (F.col("on") == F.col("_on")) & (at["to"] == aim["to"]), "left")
        none = F.col("_to").isNull()
        moved = met.select("v", "on", F.when(none, at["to"]).otherwise(F.col("_to")).alias("to"), (none | F.col("_ended")).alias("ended"), F.least("least", "_least").alias("least"))
        at = written(moved.unionByName(at.where("ended")))
        reach *= 2
        if reach > 2 * n or not at.where("not ended").take(1):
            break
    ended = at.where("ended")
    both = ended.where("not on").select("v", F.col("to").alias("before")).join(ended.where("on").select("v", F.col("to").alias("after")), "v")
    return both, at.where("on and not ended").select("v", "least")


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges whose source has a way in and whose target has a way out."""
    into, out_of = e.select(F.col("t").alias("s")).distinct(), e.select(F.col("s").alias("t")).distinct()
    return written(e.join(into, "s", "left_semi").join(out_of, "t", "left_semi").select("s", "t"))


def _coloured(e: DataFrame) -> DataFrame:
    """(v, component) of whole components: nodes that the least node which reaches them is reached from."""
    label = written(e.select(F.col("s").alias("v")).union(e.select("t")).distinct().withColumn("label", F.col("v")))
    moved = label
    while True:  # only labels that changed go on
        came = e.join(moved, F.col("s") == F.col("v")).groupBy("t").agg(F.min("label").alias("new"))
        moved = written(label.join(came, F.col("v") == F.col("t")).where("new < label").select("v", F.col("new").alias("label")))
        if not moved.take(1):
            break
        new = moved.withColumnRenamed("label", "_new")
        label = written(label.join(new, "v", "left").select("v", F.coalesce("_new", "label").alias("label")))
    end = label.select(F.col("v").alias("t"), F.col("label").alias("_l"))
    inner = written(e.join(label.withColumnRenamed("v", "s"), "s").join(end, "t").where("label = _l").select("s", "t", "label"))
    found = front = written(label.where("v = label").select("v", F.col("label").alias("component")))
    while True:
        back = inner.join(front.select(F.col("v").alias("t")), "t", "left_semi").select(F.col("s").alias("v"), F.col("label").alias("component")).distinct()
        front = written(back.join(found.select("v"), "v", "left_anti"))
        if not front.take(1):
            return found
        found = written(found.unionByName(front))


def strong_components(edges: DataFrame) -> DataFrame:
    """edges(source, target) -> (node, component, cyclic): each node that an edge names, the least node of its component, whether a path leads from it back to it.

    Chains (nodes with one way in and one out) become one edge between their ends, whatever their length,
    in rounds that grow with its logarithm; a chain's nodes are in a component if both of its ends are in the
    same one. Nodes without a way in or out are dropped. What is left gets the least node that reaches it as
    a label, and the nodes of a label from which that node is reached are a component; this takes as many
    rounds as the longest shortest path in what is left has edges. Every round ends in a written table; no path and no
    pair of nodes but the edges is ever made. Null ends are ignored, repeated edges count once, no edges give
    an empty result.
    """
    e = written(edges.select(F.col("source").alias("s"), F.col("target").alias("t")).where("s is not null and t is not null").distinct())
    live, undone, found = written(e.where("s <> t")), [], []
    while live.take(1):
        before = live.count()
        chains = _chains(live)
        if chains.take(1):
            ends, rings = _ends(chains)
            ends = written(ends)
            undone.append((len(found), ends))
            found.append(rings.select("v", F.col("least").alias("component")))
            rest = live.join(chains.select(F.col("v").alias("s")), "s", "left_anti").join(chains.select(F.col("v").alias("t")), "t", "left_anti").select("s", "t")
            short = ends.select(F.col("before").alias("s"), F.col("after").alias("t")).where("s <> t")
            live = written(rest.unionByName(short).distinct())
        for _ in range(TRIMS):
            n = live.count()
            live = _trimmed(live)
            if live.count() == n:
                break
        if live.count() < before:
            continue
        done = _coloured(live)
        found.append(done)
        gone = done.select("v")
        live = written(live.join(gone.withColumnRenamed("v", "s"), "s", "left_anti").join(gone.withColumnRenamed("v", "t"), "t", "left_anti").select("s", "t"))
    known = None
    for k in range(len(found) - 1, -1, -1):  # the last chains that were shortened have their ends among what is known
        known = found[k] if known is None else known.unionByName(found[k])
        for of, ends in undone:
            if of == k:
                at = lambda c, name: known.select(F.col("v").alias(c), F.col("component").alias(name))  # noqa: B023, E731
                met = ends.join(at("before", "_b"), "before", "left").join(at("after", "_a"), "after", "left")
                one = F.coalesce("_b", "before")
                known = written(known.unionByName(met.where(one == F.coalesce("_a", "after")).select("v", one.alias("component"))))
    nodes = e.select(F.col("s").alias("node")).union(e.select("t")).distinct()
    if known is not None:
        nodes = nodes.join(known.withColumnRenamed("v", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("_of"))
    else:
        nodes = nodes.withColumn("_of", F.col("node"))
    sizes = nodes.groupBy("_of").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("_n"))
    loops = e.where("s = t").select(F.col("s").alias("node"), F.lit(True).alias("_loop"))
    return nodes.join(sizes, "_of").join(loops, "node", "left").select("node", "component", ((F.col("_n") > 1) | F.coalesce("_loop", F.lit(False))).alias("cyclic"))
