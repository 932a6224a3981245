import zipfile

from pyspark.sql import functions as F

from tests.test_recipe import table
from tieout.model import POS, ROW
from tieout.operators import edits
from tieout.sources import drafts, exports
from tieout.streaming import windows


def cells(df):
    return {(r.row, r.column): r.value for r in df.where("kind = 'cell'").collect()}


def codes(df):
    return sorted(r.code for r in df.where("kind = 'issue'").collect())


def test_csv_drafts(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id;note\r\n1;"two\nlines"\r\n\r\n2;;x\r\n'.encode("utf-8-sig"))
    got = drafts.read_drafts(spark, str(tmp_path / "a.csv"))
    assert cells(got) == {(1, 1): "id", (1, 2): "note", (2, 1): "1", (2, 2): "two\nlines", (4, 1): "2", (4, 2): "", (4, 3): "x"} and codes(got) == ["blank_records", "ragged_row"]
    wide = {r.row: (r.c1, r.c2, r.c3) for r in drafts.as_rows(got, 3).collect()}
    assert wide[2] == ("1", "two\nlines", None)
    (tmp_path / "b.csv").write_bytes("é,1\n".encode("cp1252"))
    assert codes(drafts.read_drafts(spark, str(tmp_path / "b.csv"))) == ["encoding_assumed"]
    (tmp_path / "c.txt").write_bytes("a,b\n".encode("utf-16"))
    assert cells(drafts.read_drafts(spark, str(tmp_path / "c.txt"))) == {(1, 1): "a", (1, 2): "b"}
    (tmp_path / "d.bin").write_bytes(b"??")
    assert codes(drafts.read_drafts(spark, str(tmp_path / "d.bin"))) == ["unsupported_format"]


def test_files_come_back_as_they_were_written(spark, tmp_path):
    t = table(spark, [("=1+1", None), ("a,\"b\"", " x\ny "), ("", "é日")], ["k", "v"])
    assert exports.export_csv(t, str(tmp_path / "o.csv")) == 3
    assert (tmp_path / "o.csv").read_bytes().startswith(b"\xef\xbb\xbfk,v\r\n'=1+1,\r\n")
    assert exports.export_xlsx(t, str(tmp_path / "o.xlsx")) == 3
    assert cells(drafts.read_drafts(spark, str(tmp_path / "o.xlsx"))) == {(1, 1): "k", (1, 2): "v", (2, 1): "=1+1", (3, 1): 'a,"b"', (3, 2): " x\ny ", (4, 2): "é日"}


def test_workbooks_with_entities_are_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "e.xlsx", "w") as z:
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships/>")
        z.writestr("xl/workbook.xml", '<!DOCTYPE x [<!ENTITY a "b">]><workbook/>')
    assert codes(drafts.read_drafts(spark, str(tmp_path / "e.xlsx"))) == ["unsafe_workbook"]


def test_regions(spark):
    df = spark.createDataFrame([("p", "s", r) for r in (1, 2, 5, 6, 9)], "path string, sheet string, row long")
    got = {r.row: r.region for r in drafts.split_regions(df).collect()}
    assert got[1] == got[2] != got[5] == got[6] != got[9]


def values(t):
    return [tuple(r) for r in t.df.orderBy(POS).select(*t.keys).collect()]


def test_edits(spark):
    t = table(spark, [("a", "1"), ("b", "2"), ("b", "3")], ["k", "v"])
    fixes = spark.createDataFrame([("t:0", "v", "9", 1), ("t:0", "v", None, 2), ("t:1", "k", "c", 1)], "row_id string, column_key string, value string, seq int")
    assert values(edits.set_cells(t, fixes)) == [("a", None), ("c", "2"), ("b", "3")]
    gone = spark.createDataFrame([("t:0", "repeated"), ("t:1", " ")], "row_id string, reason string")
    assert values(edits.exclude_rows(t, gone)) == [("b", "2"), ("b", "3")]
    headed = edits.set_header(t, "t:0")
    assert headed.label("v") == "1" and len(values(headed)) == 2
    assert values(edits.split_row(t, "t:1", [{"k": "x"}, {"k": "y", "v": "5"}])) == [("a", "1"), ("x", None), ("y", "5"), ("b", "3")]
    merged, clash = edits.merge_rows(t, ["t:1", "t:2"])
    assert values(merged) == [("a", "1"), ("b", None)] and [r.column_key for r in clash.collect()] == ["v"]
    parents = edits.narrative_parents(t, F.col("k") == "a")
    assert {r[ROW]: r.parent for r in parents.collect()} == {"t:0": "t:0", "t:1": "t:0", "t:2": "t:0"}


def test_streams(spark, tmp_path):
    src = spark.sql("select timestamp'2025-01-01 00:10:00' ts, 1L user_id, 'a' event_type, 1.5D value union all select timestamp'2025-01-01 00:20:00', 1L, 'a', 2D union all select timestamp'2025-01-01 09:00:00', 1L, 'a', 1D")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream).writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, str(r.total)) for r in spark.table("hours").collect()] == [(2, "3.50")]
    assert sorted(r.n for r in windows.sessions(src).collect()) == [1, 2]
