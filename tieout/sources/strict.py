"""Files of a declared layout: exact headers, declared cells, and every record with what became of it."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .drafts import xlsx_rows

RECORDS = "path string, sha256 string, row long, end_row long, disposition string, reasons array<string>, tokens array<string>, code string"
CELL = "path string, sha256 string, cell string, value string, formula string, cached string, status string, code string"


def _files(spark: SparkSession, path: str, hashes: DataFrame | None) -> DataFrame:
    """(path, content, sha256, code) of files; code tells where a file's SHA-256 isn't the declared one of hashes(path, sha256)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))
    if hashes is None:
        return files.withColumn("code", F.lit(None).cast("string"))
    declared = F.broadcast(hashes.select(F.col("path").alias("_p"), F.col("sha256").alias("_h")))
    return files.join(declared, F.col("path").endswith(F.col("_p")), "left").withColumn("code", F.when(~F.coalesce(F.col("sha256") == F.col("_h"), F.lit(False)), "hash_mismatch")).drop("_p", "_h")


def _records(content: bytes, columns: list[str], required: list[str], delimiter: str, encoding: str) -> Iterator[tuple]:
    """(row, end_row, disposition, reasons, tokens, code) of each record after the header, or one with a code."""
    fail = lambda code: (None, None, None, None, None, code)
    try:
        text = content.decode(encoding)
    except UnicodeDecodeError:
        yield fail("invalid_encoding")
        return
    if "\0" in text:
        yield fail("malformed_csv")
        return
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True)
    try:
        if next(reader, None) != columns:
            yield fail("unsupported_layout")
            return
        before = reader.line_num
        for tokens in reader:
            reasons = ["column_count"] if len(tokens) != len(columns) else [f"missing_required:{c}" for c, v in zip(columns, tokens) if c in required and not v.strip()]
            yield before + 1, reader.line_num, "REJECTED" if reasons else "ACCEPTED", reasons, tokens, None
            before = reader.line_num
    except csv.Error:
        yield fail("malformed_csv")


def read_strict_csv(spark: SparkSession, path: str, columns: list[str], required: list[str] = (), delimiter: str = ",", encoding: str = "utf-8", hashes: DataFrame | None = None) -> DataFrame:
    """RECORDS: every record of the CSV files at path, with its lines, and whether it was accepted; a file with a code has none."""
    if len(set(columns)) != len(columns) or set(required) - set(columns) or len(delimiter) != 1 or encoding not in ("utf-8", "utf-8-sig", "cp1252"):
        raise ValueError("unsupported layout")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
        names = [part.split()[0] for part in RECORDS.split(", ")]
        for b in batches:
            for p, content, digest, code in zip(*(b.column(i).to_pylist() for i in range(4))):
                rows = [(p, digest, *x) for x in ([(None, None, None, None, None, code)] if code else _records(content, columns, list(required), delimiter, encoding))]
                for i in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 20_000]], t) for k, t in enumerate(types)], names=names)

    return _files(spark, path, hashes).mapInArrow(run, RECORDS)


def accepted(records: DataFrame, columns: list[str]) -> DataFrame:
    """The accepted records as rows of columns, with path and row."""
    return records.where("disposition = 'ACCEPTED'").select("path", "row", *[F.get("tokens", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def read_strict_xlsx(spark: SparkSession, path: str, sheet: str, cells: list[str], hashes: DataFrame | None = None) -> DataFrame:
    """CELL: the declared cells of a sheet of the workbooks at path. UNRESOLVED is a value to be interpreted;
    formulas (FORMULA_UNRESOLVED, with their cached value), dates and errors (UNSUPPORTED_TYPE) and MISSING cells are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in CELL.split(", ")]
        for b in batches:
            for p, content, digest, code in zip(*(b.column(i).to_pylist() for i in range(4))):
                rows = [(p, digest, None, None, None, None, None, code)] if code else [(p, digest, *x) for x in _cells(content, sheet, cells)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(8)], names=names)

    return _files(spark, path, hashes).mapInArrow(run, CELL)


def _cells(content: bytes, sheet: str, cells: list[str]) -> Iterator[tuple]:
    found, issue, seen = {}, None, set()
    for x in xlsx_rows(content, strict=True):
        if x[0] == "issue" and x[1] in ("malformed_workbook", "unsafe_workbook", "worksheet_missing"):
            issue = x[1]
        elif x[0] == "sheet":
            seen.add(x[1])
        elif x[0] == "cell" and x[1] == sheet:
            found[f"{_letters(x[3])}{x[2]}"] = x[4:]
    if issue or sheet not in seen:
        yield None, None, None, None, None, issue or "unsupported_layout"
        return
    for c in cells:
        value, formula, kind, number_format = found.get(c, (None, None, None, None))
        if formula is not None:
            yield c, "=" + formula, formula, value, "FORMULA_UNRESOLVED", None
        elif value is None:
            yield c, None, None, None, "MISSING", None
        else:
            odd = kind in ("e", "b", "d") or (kind == "n" and is_date_format(number_format))
            yield c, value, None, None, "UNSUPPORTED_TYPE" if odd else "UNRESOLVED", None


def _letters(column: int) -> str:
    out = ""
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def is_date_format(number_format: str | None) -> bool:
    """Whether a number format shows a day or a time: letters of dates outside quotes, brackets and escapes."""
    import re

    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", number_format or "")
    return bool(re.search("[dmyhs]", bare, re.IGNORECASE)) and bare.lower() != "general"
