"""Rebinding, signatures, digests and provenance on small cases."""

from pyspark.sql import functions as F

from tests.test_recipe import table
from tieout.operators import edits, rebinding, snapshots

TABLES = "table_id string, document_id string, title string, columns array<string>"
ROWS = "table_id string, row_id string, pos long, values array<string>"
REFS = "table_id string, header_row_id string, confirmed boolean"


def revisions(spark):
    two = ["c1", "c2"]
    old = [("a", "d", "T", two), ("b", "d", "U", two), ("c", "d", "V", two), ("e", "d", "W", two), ("f", "d", "X", two), ("g", "d2", "T", two), ("h", "d", "Y", two)]
    new = [("A", "d", "T", two), ("B", "d", "U", two), ("B2", "d", "U", two), ("C", "d", "V", ["c1"]), ("E", "d", "W", two), ("F", "d", "X", two), ("H", "d", "Y", two)]
    head, data = ["Name", "Amount"], ["x", None]
    old_rows = [(t, f"{t}:{i}", i, v) for t in "abcefgh" for i, v in ((1, head), (2, data))]
    new_rows = [("A", "A:5", 5, head), ("A", "A:6", 6, data), ("B", "B:1", 1, head), ("E", "E:1", 1, ["Name", "Total"]), ("F", "F:1", 1, head), ("F", "F:2", 2, head), ("H", "H:1", 1, head)]
    refs = [("a", "a:1", True), ("a", "a:2", True), ("h", None, True), ("zz", "zz:1", True), ("g", None, False)]
    make = spark.createDataFrame
    return make(old, TABLES), make(new, TABLES), make(old_rows, ROWS), make(new_rows, ROWS), make(refs, REFS)


def test_tables_carry_on_where_their_meaning_is_unchanged(spark):
    parts = revisions(spark)
    tables, headers = rebinding.rebound(*parts)
    got = {r.table_id: (r.status, r.new_table_id) for r in tables.collect()}
    # b has two candidates, c another schema, e another header, f its header twice, g another document, h is said to have no header
    assert got == {"a": ("kept", "A"), "b": ("ambiguous", None), "c": ("withdrawn", None), "e": ("changed", None), "f": ("changed", None), "g": ("withdrawn", None), "h": ("headerless", None)}
    assert sorted(map(tuple, headers.collect())) == [("a", "a:1", "A:5"), ("a", "a:2", "A:6")]
    carried = rebinding.carried(parts[4], tables, headers).collect()
    assert sorted(((r.table_id, r.header_row_id, r.rebound) for r in carried), key=str) == sorted([("A", "A:5", True), ("A", "A:6", True), ("h", None, False), ("zz", "zz:1", False), ("g", None, False)], key=str)
    empty = [df.limit(0) for df in parts]
    assert rebinding.rebound(*empty)[0].collect() == []


def test_signatures_change_with_meaning_alone(spark):
    old, new, old_rows, new_rows, _ = revisions(spark)
    schema = "rule_id string, part string, table_id string, header_row_id string, confirmed boolean, settings string"
    sign = lambda rows, tables, cells: {r.rule_id: r.signature for r in rebinding.rule_signatures(spark.createDataFrame(rows, schema), tables, cells).collect()}
    was = sign([("r", "left", "a", "a:1", True, "{}"), ("s", "left", "a", "a:1", True, "{}"), ("s", "right", "b", None, True, "{}"), ("t", "left", "a", None, False, "{}")], old, old_rows)
    now = sign([("r", "left", "A", "A:5", True, "{}"), ("s", "right", "B", None, True, "{}"), ("s", "left", "A", "A:5", True, "{}"), ("t", "left", "A", None, True, "{}")], new, new_rows)
    assert was["r"] == now["r"] and was["s"] == now["s"] and was["t"] != now["t"] and len(set(was.values())) == 3
    assert sign([("r", "left", "A", "A:6", True, "{}")], new, new_rows)["r"] != was["r"] != sign([("r", "left", "A", "A:5", True, '{"tolerance":"1"}')], new, new_rows)["r"]


def test_digests_follow_rows_and_not_their_order(spark):
    make = lambda rows: spark.createDataFrame(rows, "t string, a string, b int")
    sha = lambda rows: {r.table_id: r.sha256 for r in snapshots.table_digests(make(rows), "t", ["a", "b"]).collect()}
    rows = [("x", "p", 1), ("x", "q", 2), ("x", None, None), ("y", "p", 1), (None, "p", 1)]
    was = sha(rows)
    assert sha(rows[::-1]) == was and len(set(was.values())) == 2 and was["y"] == was[None]
    for other in (("x", "p", 2), ("x", "P", 1), ("x", None, 1), ("x", "null", 1)):
        assert sha([other, *rows[1:]])["x"] != was["x"]
    assert sha([*rows, rows[0]])["x"] != was["x"] != sha([*rows, rows[0], rows[0]])["x"]
    assert sha([("x", "q", 1), ("x", "p", 2), ("x", None, None)])["x"] != was["x"]


def test_output_digests_see_all_that_is_upstream(spark):
    edges = spark.createDataFrame([("a", "s"), ("b", "s"), ("s", "o"), ("c", "p"), ("gone", "p"), ("x", "y"), ("y", "x"), ("x", "ring")], "source string, target string")
    outputs = spark.createDataFrame([("o",), ("p",), ("ring",), ("alone",)], "id string")
    run = lambda rows: {r.output_id: (r.n_inputs, r.known, r.sha256) for r in snapshots.output_digests(edges, outputs, spark.createDataFrame(rows, "table_id string, sha256 string")).collect()}
    was = run([("a", "1"), ("b", "2"), ("c", "3")])
    assert was["o"][:2] == (2, True) and was["p"] == (2, False, None) and was["ring"] == was["alone"] == (0, False, None)
    assert run([("a", "1"), ("b", "9"), ("c", "3")])["o"][2] != was["o"][2] == run([("a", "1"), ("b", "2"), ("c", "8")])["o"][2]


def test_corrections_before_a_split_or_merge_are_history(spark):
    base = table(spark, [("a", "1"), ("b", "2"), ("c", "3")], ["k", "v"])
    row = lambda i, key, value, seq, who: (f"t:{i}", key, value, seq, who, "why")
    corrections = spark.createDataFrame([row(0, "v", "9", 1, "ann"), row(1, "v", "9", 1, "ann"), row(1, "k", "z", 3, "bob"), row(2, "v", "7", 1, None)], "row_id string, column_key string, value string, seq int, actor_id string, reason string")
    made = spark.createDataFrame([("t:1", 2)], "row_id string, seq int")
    now = table(spark, [("a", "9"), ("z", "9"), ("c", "7")], ["k", "v"])
    got = {(r.row_id, r.column_key): tuple(r)[2:] for r in edits.provenance(base, corrections, made, now).collect()}
    assert got["t:0", "v"] == ("1", "9", "ann", "why", True) and got["t:0", "k"] == ("a", "a", None, None, True)
    assert got["t:1", "v"] == (None, "9", None, None, False) and got["t:1", "k"] == (None, "z", "bob", "why", False)
    assert got["t:2", "v"] == ("3", "7", None, None, True)
