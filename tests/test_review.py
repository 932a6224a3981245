"""Reviews, reconciliation of mapped tables, packs, tasks and drafts on small tables."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tests.test_recipe import table
from tieout.functions import cleaning, concepts
from tieout.model import ROW
from tieout.operators import pack, revisions, tasks
from tieout.operators.review import Source, profile, run_review
from tieout.sources import blocks, drafts, exports, reports, strict


def review(sources, *checks, **config):
    found = run_review(sources, {"checks": list(checks), **config})
    return found, sorted((r.check_id, r.status, r.code, r.n_rows) for r in found.findings.where("kind not in ('coverage', 'formula_scope')").collect())


def side(name, *columns, **more):
    return {"dataset_id": name, "columns": list(columns), "header_row_id": None, **more}


def check(kind, left, right=None, **more):
    return {"id": "c", "kind": kind, "confirmed": True, "left": left} | ({"right": right} if right else {}) | more


def test_findings_name_every_row(spark):
    a = Source(table(spark, [(" x ", "1"), ("y", "2"), ("", "3"), ("y", "4")], ["k", "v"], "a"))
    b = Source(table(spark, [("x", "9")], ["k", "v"], "b"))
    found, got = review([a, b], check("reference", side("a", "k"), side("b", "k")))
    assert got == [("c", "difference", "blank_key", 1), ("c", "difference", "not_listed", 2)]
    assert sorted(r.row_id for r in found.records.collect()) == ["a:1", "a:2", "a:3"]
    assert review([a], check("unique", side("a", "k")))[1] == [("c", "difference", "blank_key", 1), ("c", "difference", "repeated_key", 2)]
    assert review([a], check("required", side("a", "k", "v")))[1] == [("c", "difference", "missing_value", 1)]
    assert review([b], check("required", side("b", "k")))[1] == [("c", "passed", "passed", 0)]
    assert review([b])[1] == [("check_scope", "needs_input", "no_checks", 0)]


def test_offsetting_errors_in_two_groups_are_two_differences(spark):
    a = Source(table(spark, [("x", "1.5e1"), ("y", "2")], ["g", "v"], "a"))
    b = Source(table(spark, [("x", "14"), ("y", "3"), ("z", "1")], ["g", "v"], "b"))
    found, got = review([a, b], check("totals", side("a", "v", group_by=["g"]), side("b", "v", group_by=["g"])))
    assert got == [("c", "difference", "group_missing", 1), ("c", "difference", "totals_differ", 2), ("c", "difference", "totals_differ", 2)]
    assert sorted(r.difference for r in found.findings.where("difference is not null").collect()) == ["-1", "1"]
    assert review([a, b], check("totals", side("a", "v"), side("b", "v")))[1] == [("c", "needs_input", "groups_missing", 0)]


def test_headers_are_found_or_asked_for(spark):
    t = table(spark, [("report", ""), ("Investor ID", "Amount"), ("7", "1"), ("8", "2")], ["c1", "c2"], "t")
    p = profile(Source(t))
    assert (p.header, p.status, p.n_data, [c["concept"] for c in p.columns]) == ("t:1", "suggested", 2, ["investor_id", "amount"])
    need = {"id": "c", "kind": "required", "confirmed": True, "left": {"dataset_id": "t", "columns": ["c1"]}}
    assert review([Source(t)], need)[1] == [("c", "needs_input", "header_unconfirmed", 0)]
    assert review([Source(t)], need, table_headers=[{"dataset_id": "t", "header_row_id": "t:1"}])[1] == [("c", "passed", "passed", 0)]
    again = table(spark, [("Investor ID", "Amount"), ("7", "1"), ("Investor ID", "Amount")], ["c1", "c2"], "t")
    assert review([Source(again)], check("required", side("t", "c1") | {"header_row_id": "t:0"}))[1] == [("c", "needs_input", "repeated_header", 0)]


def test_concepts_of_labels():
    assert concepts.concept("legalEntityName") == "entity_name" and concepts.concept("Fund investor id") == "investor_id"
    assert concepts.concept("Name", "Deal list") == "deal_name" and concepts.concept("Name") is None and concepts.concept("GL Account") == "account_id"
    assert concepts.roles({"a": "Value Date", "b": "Amount", "c": "amount"}) == {"date": "a"}


def test_blocks_of_captured_responses(spark):
    page = "<table><tr><td rowspan='2'>a</td><td>b</td></tr><tr><td>c<br>d</td></tr></table>"
    assert blocks.block_cells(page) == ("html", [(1, 1, 2, 1, "a"), (1, 2, 1, 1, "b"), (2, 2, 1, 1, "c\nd")], None)
    assert blocks.block_cells("|a|b\\|c|\n|---|:-:|")[0] == "text"
    assert blocks.block_cells("|a|b\\|c|\n|---|:---|\n||x|")[1] == [(1, 1, 1, 1, "a"), (1, 2, 1, 1, "b|c"), (2, 1, 1, 1, ""), (2, 2, 1, 1, "x")]
    for broken in ("<table><tr><td>a", "<table><tr><td><table></table></td></tr></table>", "<table></table>"):
        assert blocks.block_cells(broken)[2] == "table_unresolved"
    rows = [("p", '{"result": {"type": "full", "chunks": [{"blocks": [{"type": "Text", "content": "hello"}]}]}}'), ("q", '{"result": {"type": "url"}}'), ("r", "{")]
    got = blocks.draft_blocks(spark.createDataFrame(rows, "source string, response string"))
    assert sorted((r.source, r.value or "", r.code or "") for r in got.collect()) == [("p", "", "citation_missing"), ("p", "hello", ""), ("q", "", "malformed_response"), ("r", "", "malformed_response")]


def test_strict_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x\ny"\n2\n3,\n')
    got = strict.read_strict_csv(spark, str(tmp_path / "a.csv"), ["k", "v"], ["v"])
    assert [(r.row, r.end_row, r.disposition, r.reasons) for r in got.orderBy("row").collect()] == [(2, 3, "ACCEPTED", []), (4, 4, "REJECTED", ["column_count"]), (5, 5, "REJECTED", ["missing_required:v"])]
    assert strict.accepted(got, ["k", "v"]).first().v == "x\ny"
    assert [r.code for r in strict.read_strict_csv(spark, str(tmp_path / "a.csv"), ["v", "k"]).collect()] == ["unsupported_layout"]
    wrong = spark.createDataFrame([("a.csv", "0" * 64)], "path string, sha256 string")
    assert [r.code for r in strict.read_strict_csv(spark, str(tmp_path / "a.csv"), ["k", "v"], hashes=wrong).collect()] == ["hash_mismatch"]


def test_typed_workbooks_and_filled_cells(spark, tmp_path):
    t = table(spark, [("a", "1.50", "2024-03-01"), ("b", "-2", "")], ["k", "n", "d"])
    path = str(tmp_path / "t.xlsx")
    assert exports.export_xlsx(t, path, types={"n": "decimal", "d": "date"}) == 2
    got = {c.cell: (c.value, c.status) for c in strict.read_strict_xlsx(spark, path, "Sheet1", ["A2", "B2", "C2", "C3"]).collect()}
    assert got == {"A2": ("a", "UNRESOLVED"), "B2": ("1.50", "UNRESOLVED"), "C2": ("45352", "UNSUPPORTED_TYPE"), "C3": (None, "MISSING")}
    with pytest.raises(ValueError):
        exports.export_xlsx(table(spark, [("1234567890.1234567",)], ["n"]), path, types={"n": "decimal"})
    with open(path, "rb") as f:
        book = f.read()
    filled = exports.fill_cells(book, "Sheet1", {"C3": "new", "E9": "far"})
    cells = {(x[2], x[3]): x[4] for x in drafts.xlsx_rows(filled) if x[0] == "cell"}
    assert cells[(3, 3)] == "new" and cells[(9, 5)] == "far" and cells[(2, 1)] == "a"
    for wrong in ({"A2": "x"}, {"nope": "x"}):
        with pytest.raises(ValueError):
            exports.fill_cells(book, "Sheet1", wrong)
    assert exports.fill_cells(book, "Sheet1", {"A2": "x"}, bound=True)
    (tmp_path / "after").mkdir()
    (tmp_path / "after" / "t.xlsx").write_bytes(filled)
    with zipfile.ZipFile(tmp_path / "after" / "t.xlsx", "a") as z:
        z.writestr("xl/media/image1.png", b"x")
    changes = revisions.workbook_diff(spark, path, str(tmp_path / "after"))
    assert [r.change for r in changes.collect()] == ["package_part_changed"]


def test_task_stream_agrees_with_batches(spark, tmp_path):
    rows = [("a", "requirement", "investor", 1, "evaluated:FAIL", "f"), ("a", "requirement", "investor", 2, "release", None), ("a", "requirement", "investor", 3, "evaluated:FAIL", "g"), ("b", "manual", "accountant", 1, "created", None), ("b", "manual", "accountant", 2, "resolve", None), ("b", "manual", "accountant", 3, "reopen", None)]
    schema = "task_id string, kind string, party string, seq int, action string, fingerprint string"
    df = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, tasks.task_states(df).collect()))
    assert [(r[0], r[3], r[4]) for r in want] == [("a", "pending_manager_release", 2), ("b", "open", 2)]
    df.write.json(str(tmp_path / "in"))
    out = tasks.task_stream(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("t_states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert sorted(map(tuple, spark.table("t_states").collect())) == want


def test_routes(spark):
    packs = spark.createDataFrame([("p", True, False, True, True, False, "AGREE", "0.1"), ("q", True, False, True, True, False, "DISAGREE", None), ("r", True, False, True, True, False, "NOT_RUN", None)], "pack_id string, native boolean, unverifiable boolean, evidence_complete boolean, context_complete boolean, unresolved boolean, agreement string, confidence string")
    made = spark.createDataFrame([("p", "fee", True, "PASS", None, None), ("q", "fee", True, "NOT_APPLICABLE", False, "none"), ("r", "fee", True, "NOT_APPLICABLE", False, " ")], "pack_id string, id string, required boolean, status string, applicable boolean, justification string")
    got = {r.pack_id: (r.route, r.reasons) for r in pack.routes(packs, made, ["fee"]).collect()}
    assert got == {"p": ("READY", []), "q": ("NEEDS_REVIEW", ["disagreement"]), "r": ("BLOCKED", ["check:fee"])}
    assert pack.routes(packs.limit(1), made, ["fee", "x"]).first().reasons == ["missing:x"]


def test_pack_numbers(spark):
    df = spark.createDataFrame([("(1,234.5)", "thousands"), ("NA", "units"), ("(-1)", "units"), ("1e3", "millions"), ("12,34", "units"), ("-0.5", "thousands")], "x string, s string")
    n = cleaning.pack_number(F.col("x"))
    assert [tuple(r) for r in df.select(n, cleaning.in_units(F.when(n != "invalid", n), F.col("s"))).collect()] == [("-1234.5", "-1234500"), (None, None), ("invalid", None), ("1000", "1000000000"), ("invalid", None), ("-0.5", "-500")]


def test_manifests():
    snapshot = {"sources": [{"source_id": "s", "content_hash": "h", "locator": {"row": 1}}], "facts": [{"fact_id": "f", "source_id": "s"}], "checks": [{"id": "fee"}]}
    approval = {"snapshot_digest": reports.digest(snapshot), "artifact_sha256": reports.sha256(b"x").hexdigest()}
    made = reports.pack_manifest(snapshot, b"x", approval)
    assert reports.verified(made, b"x") and not reports.verified(made, b"y")
    with pytest.raises(ValueError):
        reports.pack_manifest(snapshot | {"checks": []}, b"x", approval)
    assert "&lt;b&gt;" in reports.brief("<b>", [], [], [])


def test_lineage_of_a_melted_cell(spark):
    from tests.test_recipe import run

    r = run(table(spark, [("1", "a", "b")], ["id", "x", "y"]), {"op": "reshape", "mode": "melt", "id_columns": ["id"], "value_columns": ["x", "y"]})
    refs = r.lineage(["value"]).join(r.output.df.select(F.col(ROW).alias("row_id"), "variable"), "row_id")
    assert sorted((x.variable, x.source_row, x.source_column) for x in refs.collect()) == [("x", "t:0", "x"), ("y", "t:0", "y")]
