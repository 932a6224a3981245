"""Draft tables out of files: every cell as text with its place, no header taken, odd rows kept and reported.

Workbooks are read by one task each; many files spread over the cluster. Delimited files are read by splits.
A workbook's rows come out as they are parsed, so a task holds the file's bytes and one row.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A row for each cell and each issue of a file; kind and number_format are a workbook's, region its declared table.
CELLS = "path string, sha256 string, kind string, sheet string, row long, column int, value string, formula string, cell_type string, number_format string, hidden boolean, region string, code string"
DELIMITERS = (",", ";", "\t", "|")
SAMPLE, SAMPLE_ROWS = 1 << 16, 100
BATCH = 20_000
#: Delimited files up to so many bytes get the SHA-256 of their bytes.
HASHED = 64 << 20
#: Formats that workbooks don't spell out.
NUMBER_FORMATS = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@"}


def decoded(content: bytes) -> tuple[str | None, str | None]:
    """(text, issue): UTF-8, UTF-16 by its mark, else Windows-1252, which is reported."""
    try:
        if content.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
            text, issue = content.decode("utf-16"), None
        else:
            text, issue = content.decode("utf-8-sig"), None
    except UnicodeDecodeError:
        try:
            text, issue = content.decode("cp1252"), "encoding_assumed"
        except UnicodeDecodeError:
            return None, "unsupported_encoding"
    return (None, "invalid_text") if "\0" in text else (text, issue)


def delimiter(text: str, path: str) -> tuple[str, str | None]:
    """The delimiter by which most whole records of a sample agree on several fields; ties and guesses are reported."""
    sample, scores = text[:SAMPLE], {}
    for d in DELIMITERS:
        records: list[list[str]] = []
        try:
            for _, r in zip(range(SAMPLE_ROWS + 1), csv.reader(io.StringIO(sample, newline=""), delimiter=d)):
                records.append(r)
        except csv.Error:
            continue
        if len(text) > SAMPLE and len(records) <= SAMPLE_ROWS:
            records = records[:-1]  # the sample may end inside its last record
        sizes = [len(r) for r in records[:SAMPLE_ROWS] if any(r)]
        wide = [n for n in sizes if n > 1]
        if wide:
            most = max(sorted(set(wide)), key=wide.count)
            scores[d] = (wide.count(most) / len(sizes), most)
    if path.lower().endswith(".tsv") and "\t" in scores:
        return "\t", None
    if not scores:
        return ",", "delimiter_assumed"
    best = max(scores.values())
    tied = [d for d in DELIMITERS if scores.get(d) == best]
    return tied[0], "delimiter_ambiguous" if len(tied) > 1 else None


def csv_rows(content: bytes, path: str) -> Iterator[tuple[str, int, list[str] | str]]:
    """('row', number, cells) of each record that isn't blank, and ('issue', record or count, code): one for each ragged record."""
    text, issue = decoded(content)
    if issue:
        yield "issue", 0, issue
    if text is None:
        return
    d, issue = delimiter(text, path)
    if issue:
        yield "issue", 0, issue
    width, n, blank = None, 0, 0
    csv.field_size_limit((1 << 31) - 1)
    try:
        for number, record in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=d, strict=True), 1):
            if not record:
                blank += 1
                continue
            n += 1
            width = len(record) if width is None else width
            if len(record) != width:
                yield "issue", number, "ragged_row"
            yield "row", number, record
    except csv.Error:
        yield "issue", n, "malformed_csv"
    if not n:
        yield "issue", 0, "no_tabular_content"
    if blank:
        yield "issue", blank, "blank_records"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _safe_xml(data: bytes) -> bytes:
    """The whole part, if it declares no document type or entity, in whatever encoding."""
    for name in (b"<!DOCTYPE", b"<!ENTITY"):
        if name in data.upper() or name.decode().encode("utf-16-le") in data or name.decode().encode("utf-16-be") in data:
            raise UnsafeWorkbook(name.decode())
    return data


class UnsafeWorkbook(ValueError):
    """A part that is refused."""


def column_number(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n


def _relations(book: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """id -> (kind, part) of what a part of the workbook refers to, inside the workbook alone."""
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels"
    if path not in book.namelist():
        return {}
    out = {}
    for r in ElementTree.fromstring(_safe_xml(book.read(path))):
        target = r.get("Target") or ""
        if r.get("TargetMode") == "External":
            continue
        steps: list[str] = [] if target.startswith("/") else folder.split("/")
        for step in target.strip("/").split("/"):
            if step == ".." and not steps or "\\" in step:
                raise UnsafeWorkbook(target)
            steps = steps[:-1] if step == ".." else [*steps, step]
        out[r.get("Id")] = ((r.get("Type") or "").rpartition("/")[2], "/".join(steps))
    return out


def _formats(book: zipfile.ZipFile) -> list[str]:
    """The number format of each cell style."""
    if "xl/styles.xml" not in book.namelist():
        return []
    own, styles = dict(NUMBER_FORMATS), []
    for part in ElementTree.fromstring(_safe_xml(book.read("xl/styles.xml"))):
        if _local(part.tag) == "numFmts":
            own |= {int(f.get("numFmtId")): f.get("formatCode") for f in part}
        elif _local(part.tag) == "cellXfs":
            styles = [int(x.get("numFmtId") or 0) for x in part]
    return [own.get(i, f"format {i}") for i in styles]


def _area(reference: str) -> tuple[int, int, int, int]:
    """(first row, first column, last row, last column) of an A1 reference."""
    ends = [re.fullmatch(r"\$?([A-Za-z]+)\$?([0-9]+)", e) for e in (reference.split(":") * 2)[:2]]
    if not all(ends):
        raise ValueError(reference)
    (c1, r1), (c2, r2) = ((column_number(e[1]), int(e[2])) for e in ends)
    return r1, c1, r2, c2


def xlsx_rows(content: bytes, strict: bool = False) -> Iterator[tuple]:
    """('sheet', name, hidden), ('merged' | 'table', sheet, reference, name), ('cell', sheet, row, column, value, formula, type, number format) of each cell that holds something, and ('issue', code).

    Numbers stay as they are written. strict refuses workbooks with macros or links to others.
    """
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        names = set(book.namelist())
        if strict and any("vbaProject" in n or n.startswith("xl/externalLinks/") or n == "EncryptedPackage" for n in names):
            raise UnsafeWorkbook("macros or links")
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(_safe_xml(book.read("xl/sharedStrings.xml"))):
                shared.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t"))
        formats, targets = _formats(book), _relations(book, "xl/workbook.xml")
        for s in ElementTree.fromstring(_safe_xml(book.read("xl/workbook.xml"))).iter():
            if _local(s.tag) != "sheet":
                continue
            yield "sheet", s.get("name"), s.get("state", "visible") != "visible"
            _, part = next((targets[v] for k, v in s.attrib.items() if _local(k) == "id" and v in targets), ("", ""))
            if part not in names:
                yield "issue", "worksheet_missing"
                continue
            for kind, table in _relations(book, part).values():
                if kind == "table" and table in names:
                    root = ElementTree.fromstring(_safe_xml(book.read(table)))
                    yield "table", s.get("name"), root.get("ref"), root.get("displayName") or root.get("name")
            yield from _sheet(io.BytesIO(_safe_xml(book.read(part))), s.get("name"), shared, formats)
    except UnsafeWorkbook:
        yield "issue", "unsafe_workbook"
    except (zipfile.BadZipFile, KeyError, ValueError, IndexError, TypeError, ElementTree.ParseError):
        yield "issue", "malformed_workbook"


def _sheet(part: io.BytesIO, name: str, shared: list[str], formats: list[str]) -> Iterator[tuple]:
    for _, node in ElementTree.iterparse(part):
        tag = _local(node.tag)
        if tag == "mergeCell":
            yield "merged", name, node.get("ref"), None
        if tag != "row":
            continue
        for cell in node:
            kind, value, formula = cell.get("t", "n"), None, None
            for x in cell.iter():
                if _local(x.tag) == "v" or kind == "inlineStr" and _local(x.tag) == "t":
                    value = (value or "") + (x.text or "")
                elif _local(x.tag) == "f":
                    formula = x.text or ""
            if kind == "s" and value is not None:
                value = shared[int(value)]
            if kind == "e":
                yield "issue", "spreadsheet_error"
            if formula is not None and value is None:
                yield "issue", "formula_cache_missing"
            style = int(cell.get("s") or 0)
            if value is not None or formula is not None:
                yield "cell", name, int(node.get("r")), column_number(cell.get("r")), value, formula, kind, formats[style] if style < len(formats) else None
        node.clear()


def _draft(path: str, content: bytes) -> Iterator[tuple]:
    """Tuples of CELLS without path and sha256."""
    issue = lambda code, number=None, sheet=None: ("issue", sheet, number, None, None, None, None, None, None, None, code)
    if content[:2] == b"PK":
        hidden: dict[str, bool] = {}
        tables: dict[str, list[tuple]] = {}
        for x in xlsx_rows(content):
            if x[0] == "issue":
                yield issue(x[1])
            elif x[0] == "sheet":
                hidden[x[1]] = x[2]
            elif x[0] == "table":
                tables.setdefault(x[1], []).append((*_area(x[2]), x[3]))
            elif x[0] == "merged":
                yield "merged", x[1], None, None, x[2], None, None, None, hidden.get(x[1]), None, None
            else:
                _, sheet, row, column, value, formula, kind, number_format = x
                region = next((t[4] for t in tables.get(sheet, ()) if t[0] <= row <= t[2] and t[1] <= column <= t[3]), None)
                yield "cell", sheet, row, column, value, formula, kind, number_format, hidden.get(sheet), region, None
    elif path.lower().endswith((".csv", ".tsv", ".txt")):
        for kind, number, what in csv_rows(content, path):
            if kind == "issue":
                yield issue(what, number, "")
            else:
                for i, value in enumerate(what, 1):
                    yield "cell", "", number, i, value, None, None, None, False, None, None
    else:
        yield issue("unsupported_format")


def columns_of(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _read_whole(files: DataFrame) -> DataFrame:
    """CELLS of files(path, content, sha256), each read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]
        names = [part.split()[0] for part in CELLS.split(", ")]
        for b in batches:
            for p, content, digest in zip(*(b.column(i).to_pylist() for i in range(3))):
                held: list[tuple] = []
                for x in _draft(p, content):
                    held.append((p, digest, *x))
                    if len(held) >= BATCH:
                        yield columns_of(held, types, names)
                        held = []
                if held:
                    yield columns_of(held, types, names)

    return files.select("path", "content", "sha256").mapInArrow(run, CELLS)


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    """CELLS: a row for each cell, merged range and issue of the files at path (CSV, TSV, TXT, XLSX).

    Delimited files are parsed by as many tasks as they have splits (see split_csv), workbooks and the few
    delimited files that can't be split by one task each. sha256 is that of the file's bytes; a delimited file
    of more than HASHED bytes has null there, as its bytes never come together.
    """
    from .split_csv import read_split_csv

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.col("_metadata.file_path").alias("path"), "content", F.sha2("content", 256).alias("sha256"), "length")
    delimited = F.lower("path").rlike(r"\.(csv|tsv|txt)$")
    out = _read_whole(files.where(~delimited))
    if not files.select("path").where(delimited).take(1):
        return out
    cells, whole = read_split_csv(spark, path)
    small = files.where(delimited & (F.col("length") <= HASHED)).select("path", F.col("sha256").alias("_sha256"))
    cells = cells.join(small, "path", "left").withColumn("sha256", F.col("_sha256")).drop("_sha256").select(*out.columns)
    if whole.take(1):
        out = out.unionByName(_read_whole(files.where(delimited).join(whole, "path", "left_semi")))
    return out.unionByName(cells)


def as_rows(cells: DataFrame, width: int) -> DataFrame:
    """(path, sheet, row, c1..cN): the cells of each row side by side; a row that lacks a cell has null there."""
    picked = [F.max(F.when(F.col("column") == i, F.col("value"))).alias(f"c{i}") for i in range(1, width + 1)]
    return cells.where("kind = 'cell'").groupBy("path", "sheet", "row").agg(*picked)


def split_regions(rows: DataFrame) -> DataFrame:
    """rows with region: a new one begins where a row number is left out."""
    return rows.withColumn("region", F.col("row") - F.row_number().over(Window.partitionBy("path", "sheet").orderBy("row")))


def suggested_header(rows: DataFrame) -> DataFrame:
    """(path, sheet, row): the first row of each table, if all its cells hold text and none is a number."""
    keys = [c for c in rows.columns if c.startswith("c") and c[1:].isdigit()]
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("path", "sheet").orderBy("row"))).where("_n = 1")
    text = [F.coalesce(F.trim(F.col(k)), F.lit("")) for k in keys]
    fine = reduce(Column.__and__, [(t != "") & ~t.rlike(r"^[+-]?[0-9.,]+$") for t in text])
    return first.where(fine).select("path", "sheet", "row")
