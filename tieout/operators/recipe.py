"""Declarative recipes: steps, then checks on their results. Everything is planned before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Table
from . import checks
from .lineage import lineage
from .steps import STEPS, issues, together

MOST_STEPS, MOST_CHECKS = 64, 100


@dataclass
class Result:
    output: Table
    tables: dict[str, Table]
    issues: DataFrame | None
    #: (id, type, table_id, passed), one row a check
    checks: DataFrame | None

    def lineage(self, keys: list[str] | None = None) -> DataFrame:
        """The source cells of the output's cells."""
        return lineage(self.output, keys)

    def rows(self) -> DataFrame:
        return self.output.df.select(*[F.col(f"`{k}`") for k in self.output.keys])


def run_recipe(tables: list[Table], recipe: dict) -> Result:
    """The plans of a recipe's output, issues and checks. Wrong recipes raise ValueError; wrong data become issues."""
    if not isinstance(recipe, dict) or recipe.get("version") != 1:
        raise ValueError("recipe version must be 1")
    steps, asked = recipe.get("steps", []), recipe.get("checks", [])
    if not isinstance(steps, list) or len(steps) > MOST_STEPS or not isinstance(asked, list) or len(asked) > MOST_CHECKS:
        raise ValueError("too many steps or checks")
    known = {t.table_id: t for t in tables}
    if len(known) != len(tables):
        raise ValueError("table ids must be different")
    found = []
    for step in steps:
        if not isinstance(step, dict) or not isinstance(step.get("id"), str) or not step["id"] or step["id"] in known:
            raise ValueError("steps need new ids")
        if step.get("input") not in known or step.get("op") not in STEPS:
            raise ValueError(f"step {step['id']}: unknown input or operation")
        made, new = STEPS[step["op"]](known[step["input"]], step, known)
        known[step["id"]] = replace(made, table_id=step["id"], title=step.get("title", step["id"]))
        found += new
    output = known.get(recipe.get("output"))
    if output is None:
        raise ValueError("output must name a table or step")
    results = []
    for i, check in enumerate(asked):
        on = known.get(check.get("table", output.table_id)) if isinstance(check, dict) else None
        if on is None:
            raise ValueError("a check names an unknown table")
        new, passed = checks.recipe_check(on, check)
        found.append(new)
        row = passed.select(F.lit(check.get("id", f"check-{i + 1}")).alias("id"), F.lit(check["type"]).alias("type"), F.lit(on.table_id).alias("table_id"), "passed")
        results.append(row)
    empty = output.df.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    found.append(issues(empty, "empty_output", "no_rows", output.table_id, row=None, severity="warning"))
    return Result(output, known, together(found), together(results))
