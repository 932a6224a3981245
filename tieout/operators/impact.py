"""What depends on a change, and how a pack of checked facts is routed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.decimals import canonical_text
from .strong import strong_components

#: Rounds after which what was seen becomes one table again.
CUT = 8


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(start, node, depth): every node that a path from start leads to, at its least depth. Edges are (source, target).

    The frontier moves one edge a round until it is empty; only new pairs go on, so cycles end. Each
    frontier is checkpointed, and what was seen every few rounds, so that plans stay short on long paths.
    """
    e = checkpointed(edges.select(F.col("source").alias("_s"), F.col("target").alias("_t")).distinct())
    front = seen = checkpointed(start.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    depth = 0
    while True:
        depth += 1
        new = front.join(e, F.col("node") == F.col("_s")).select("start", F.col("_t").alias("node")).distinct()
        front = checkpointed(new.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not front.take(1):
            return seen.where("depth > 0")
        seen = seen.unionByName(front)
        if depth % CUT == 0:
            seen = checkpointed(seen)


def cyclic(edges: DataFrame) -> DataFrame:
    """(node): nodes that a path leads back to. Nothing that depends on one is independent of a change."""
    return strong_components(edges).where("cyclic").select("node")


def priority(amount: Column, least: str, outputs: Column, many: int) -> Column:
    """HIGH where an amount (a DECIMAL) or the number of outputs that depend on it is large."""
    return F.when((F.abs(amount) >= F.lit(canonical_text(least, negative=False)).cast("decimal(38,12)")) | (outputs >= many), "HIGH").otherwise("STANDARD")


def dependencies(recipe: dict, output: str | None = None) -> set[str]:
    """The tables and steps that a step of a recipe (by default its output) is made of, with the tables that its checks read."""
    steps = {s["id"]: s for s in recipe.get("steps", [])}
    todo = [output or recipe["output"]] + ([c.get("table", recipe["output"]) for c in recipe.get("checks", [])] if output is None else [])
    found: set[str] = set()
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            step = steps.get(name, {})
            todo += [x for x in (step.get("input"), step.get("right")) if x]
    return found
