"""Cells come once in a lineage, and rows are held against each other only where one could come twice."""

from tieout.model import ROW, table_of
from tieout.operators.lineage import paths
from tieout.operators.recipe import run_recipe


def run(tables, *steps):
    chain = [{"id": f"s{i}", "input": tables[0].table_id if i == 0 else f"s{i - 1}"} | s for i, s in enumerate(steps)]
    return run_recipe(tables, {"version": 1, "steps": chain, "output": chain[-1]["id"], "checks": []})


SUM = {"op": "aggregate", "by": ["g"], "metrics": {"s": {"op": "sum", "column": "x"}}}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_groups_are_not_compared_row_by_row(spark):
    t = table_of(spark.createDataFrame([(i, i % 3, i) for i in range(30)], "k int, g int, x int"), "t", ["g", "x"])
    r = run([t], {"op": "derive", "columns": {"y": {"column": "x"}}}, SUM)
    got = r.lineage(["s"])
    assert all(p.once for p in paths(r.output)) and "source_row#" not in [x for x in plan(got).splitlines() if "Aggregate" in x][0]
    assert got.count() == got.distinct().count() == 30


def test_cells_that_part_and_meet_again_come_once(spark):
    left = table_of(spark.createDataFrame([(1, 7), (2, 8)], "g int, x int"), "l", ["g", "x"])
    right = table_of(spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k int, y int"), "r", ["k", "y"])
    r = run([left, right], {"op": "join", "cardinality": "one_to_many", "right": "r", "on": [{"left": "g", "right": "k"}], "columns": {"y": "y"}}, SUM)
    assert [p.once for p in paths(r.output)] == [False]
    assert sorted(tuple(x) for x in r.lineage(["s"]).select("source_table", "source_column").collect()) == [("l", "x"), ("l", "x")]
    # a table joined with itself is reached by two paths
    own = run([left], {"op": "lookup", "right": "l", "on": [{"left": "g", "right": "g"}], "columns": {"x": "z"}}, {"op": "derive", "columns": {"w": {"op": "add", "args": [{"column": "x"}, {"column": "z"}]}}})
    assert sorted(x.source_row for x in own.lineage(["w"]).collect()) == sorted(x[ROW] for x in left.df.collect())
