import pytest

from tieout.model import table_of
from tieout.operators.recipe import run_recipe


def table(spark, rows, keys, name="t"):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "p long, " + ", ".join(f"{k} string" for k in keys))
    return table_of(df, name, list(keys), F.col("p"))


def run(t, *steps, checks=None, more=()):
    chain = [{"id": f"s{i}", "input": t.table_id if not i else f"s{i - 1}"} | s for i, s in enumerate(steps)]
    return run_recipe([t, *more], {"version": 1, "steps": chain, "output": chain[-1]["id"] if chain else t.table_id, "checks": checks or []})


def rows(result):
    return [tuple(r) for r in result.output.df.orderBy("_pos", "_row_id").select(*[f"`{k}`" for k in result.output.keys]).collect()]


def codes(result):
    return sorted((r.code, r.column_key) for r in result.issues.collect())


COL = lambda k: {"column": k}
OP = lambda op, *a, **m: {"op": op, "args": list(a), **m}
LIT = lambda v: {"literal": v}


def derived(spark, values, expr):
    r = run(table(spark, [(v,) for v in values], ["x"]), {"op": "derive", "columns": {"y": expr}}, {"op": "select", "columns": ["y"]})
    return [y for (y,) in rows(r)], codes(r)


def test_sums_keep_the_digits_that_exact_arithmetic_gives(spark):
    got, found = derived(spark, ["0.1", "9.99"], OP("add", COL("x"), LIT("0.2")))
    assert got == ["0.3", "10.19"] and not found
    assert derived(spark, ["9.99", "-0.50"], OP("add", COL("x"), LIT("0.01")))[0] == ["10.00", "-0.49"]
    assert derived(spark, ["2.5"], OP("multiply", COL("x"), LIT("1.50")))[0] == ["3.750"]


def test_division_and_rounding_are_half_even(spark):
    assert derived(spark, ["2.345", "2.355", "-2.345"], OP("round", COL("x"), scale=2))[0] == ["2.34", "2.36", "-2.34"]
    assert derived(spark, ["1", "-1", "0.5"], OP("divide", COL("x"), LIT("3"), scale=4))[0] == ["0.3333", "-0.3333", "0.1667"]
    assert derived(spark, ["1", "3"], OP("divide", COL("x"), LIT("8"), scale=2))[0] == ["0.12", "0.38"]
    assert derived(spark, ["1"], OP("divide", COL("x"), LIT("0")))[0] == [None]


@pytest.mark.parametrize("bad", [None, "NaN", "Infinity", "1,000", "garbage", "1e4", " 12 "])
def test_what_is_no_canonical_decimal_is_an_issue(spark, bad):
    assert derived(spark, [bad], OP("add", COL("x"), LIT("1"))) == ([None], [("invalid_expression_value", "y")])


def test_derive_reads_the_input_as_it_was(spark):
    r = run(table(spark, [("1", "2")], ["a", "b"]), {"op": "derive", "columns": {"a": COL("b"), "b": COL("a")}})
    assert rows(r) == [("2", "1")]


def test_locale_decimals_and_dates(spark):
    assert derived(spark, ["1.234,50", "12.34,5", "-7", "+0,5"], OP("decimal", COL("x"), decimal_separator=",", thousands_separator="."))[0] == ["1234.50", None, "-7", "0.5"]
    assert derived(spark, ["1/2/2025", "31/04/2025"], OP("date", COL("x"), format="%d/%m/%Y"))[0] == ["2025-02-01", None]


def test_trim_takes_unicode_space(spark):
    assert derived(spark, ["\t a "], OP("trim", COL("x")))[0] == ["a"]


@pytest.mark.parametrize(
    "where, kept",
    [
        ({"column": "x", "operator": "eq", "value": None}, [None]),
        ({"column": "x", "operator": "ne", "value": "5"}, [None, "10", "bad"]),
        ({"not": {"column": "x", "operator": "gt", "value": "6"}}, [None, "5", "10"]),
        ({"column": "x", "operator": "gt", "value": "6", "type": "decimal"}, ["10", "bad"]),
        ({"any": [{"column": "x", "operator": "is_null"}, {"column": "x", "operator": "in", "value": ["5"]}]}, [None, "5"]),
    ],
)
def test_filters(spark, where, kept):
    r = run(table(spark, [(None,), ("5",), ("10",), ("bad",)], ["x"]), {"op": "filter", "where": where})
    assert [x for (x,) in rows(r)] == kept


def test_conditions_stop_at_the_part_that_decides(spark):
    null = {"column": "x", "operator": "contains", "value": "a"}
    number = {"column": "x", "operator": "gt", "value": "1", "type": "decimal"}
    t = table(spark, [("bad",), ("2",)], ["x"])
    assert not codes(run(t, {"op": "filter", "where": {"any": [null, number]}}))
    assert codes(run(t, {"op": "filter", "where": {"any": [number, null]}})) == [("invalid_filter_value", None)]


def test_joins(spark):
    left = table(spark, [("a",), ("b",), ("",), (None,), ("c",)], ["k"])
    right = table(spark, [("a", "1"), ("b", "2"), ("b", "3"), ("", "4")], ["k", "v"], "r")
    step = {"op": "join", "right": "r", "on": [{"left": "k", "right": "k"}], "columns": {"v": "w"}}
    r = run(left, step, more=[right])
    assert rows(r) == [("a", "1"), ("b", None), ("", None), (None, None), ("c", None)]
    assert [c for c, _ in codes(r)] == ["ambiguous_join"] + ["unmatched_join"] * 3
    r = run(left, step | {"how": "inner"}, more=[right])
    assert rows(r) == [("a", "1")] and len(codes(r)) == 4
    r = run(left, step | {"cardinality": "one_to_many"}, more=[right])
    assert sorted(map(str, rows(r))) == sorted(map(str, [("a", "1"), ("b", "2"), ("b", "3"), ("", None), (None, None), ("c", None)]))
    with pytest.raises(ValueError):
        run(left, step | {"how": "full"}, more=[right])


def test_aggregate_poisons_groups_and_gives_none_for_no_rows(spark):
    t = table(spark, [("g", "1.50"), ("g", "2"), ("h", "x"), ("h", "1"), (None, "7")], ["g", "x"])
    r = run(t, {"op": "aggregate", "by": ["g"], "metrics": {"s": {"op": "sum", "column": "x"}, "m": {"op": "max", "column": "x"}, "n": {"op": "count"}}})
    assert rows(r) == [("g", "3.50", "2", "2"), ("h", None, None, "2"), (None, "7", "7", "1")]
    empty = run(table(spark, [], ["x"]), {"op": "aggregate", "by": [], "metrics": {"n": {"op": "count"}}})
    assert rows(empty) == [] and codes(empty) == [("empty_output", None)]


def test_sort_puts_null_and_invalid_last(spark):
    t = table(spark, [("2",), (None,), ("10",), ("x",)], ["x"])
    assert [x for (x,) in rows(run(t, {"op": "sort", "by": [{"column": "x", "type": "decimal", "direction": "desc"}]}))] == ["10", "2", None, "x"]


def test_classify_needs_exactly_one_rule(spark):
    t = table(spark, [("a",), ("ab",), ("z",)], ["x"])
    rules = [{"when": {"column": "x", "operator": "contains", "value": c}, "value": c.upper()} for c in "ab"]
    r = run(t, {"op": "classify", "column": "c", "rules": rules})
    assert rows(r) == [("a", "A"), ("ab", None), ("z", None)]
    assert codes(r) == [("ambiguous_classification", "c"), ("unmatched_classification", "c")]


def test_allocation_comes_to_the_total(spark):
    t = table(spark, [("f", "1"), ("f", "1"), ("f", "1"), ("g", "-1"), ("g", "2")], ["f", "w"])
    r = run(t, {"op": "allocate", "by": ["f"], "weight": "w", "total": LIT("100.00"), "column": "share"})
    assert [x for _, _, x in rows(r)] == ["33.34", "33.33", "33.33", None, None] and codes(r) == [("invalid_allocation", "share")]
    r = run(t, {"op": "filter", "where": {"column": "f", "operator": "eq", "value": "f"}}, {"op": "allocate", "weight": "w", "total": LIT("-1"), "column": "share"})
    assert [x for _, _, x in rows(r)] == ["-0.34", "-0.33", "-0.33"]


def test_reshape(spark):
    t = table(spark, [("1", "a", "x"), ("1", "a", "y"), ("2", "b", None), ("3", "q", "z")], ["id", "k", "v"])
    r = run(t, {"op": "reshape", "mode": "melt", "id_columns": ["id"], "value_columns": ["k", "v"]})
    assert len(rows(r)) == 8 and ("2", "v", None) in rows(r)
    r = run(t, {"op": "reshape", "mode": "pivot", "id_columns": ["id"], "variable_column": "k", "value_column": "v", "columns": {"a": "A", "b": "B"}})
    assert rows(r) == [("1", None, None), ("2", None, None), ("3", None, None)]
    assert codes(r) == [("ambiguous_pivot", "A"), ("unmapped_pivot_value", "k")]


def test_checks(spark):
    t = table(spark, [("a", "1", "1"), ("a", "2", "1"), (" ", "x", "1")], ["k", "d", "c"])
    asked = [{"type": "required", "columns": ["k"]}, {"type": "unique", "columns": ["k"]}, {"type": "total", "column": "c", "expected": "3.01", "tolerance": "0.01"}, {"type": "balance", "debit": "d", "credit": "c"}]
    r = run(t, checks=asked)
    assert [c.passed for c in r.checks.collect()] == [False, False, True, False]
    assert codes(r) == [("duplicate_key", None), ("invalid_check_value", None), ("required_value", "k")]


def test_wrong_recipes_are_refused(spark):
    t = table(spark, [("a",)], ["k"])
    for step in ({"op": "select", "columns": ["nope"]}, {"op": "filter", "where": {}}, {"op": "union"}, {"op": "rename", "columns": {"k": ""}}):
        with pytest.raises(ValueError):
            run(t, step)
