"""What changed between two revisions of a table, row by row and cell by cell."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import POS, Table


def _c(side: str, key: str) -> Column:
    return F.col(f"{side}.`{key}`")


def _cells(both: DataFrame, where: list[Column], keys: list[str], moved: Column) -> DataFrame:
    """One row for each cell that differs: added and removed rows count all their cells that hold something."""
    gone, come = F.col("b._there").isNull(), F.col("a._there").isNull()
    cells = F.array(*[F.struct(F.lit(k).alias("column_key"), _c("a", k).alias("before"), _c("b", k).alias("after")) for k in keys])
    rows = both.select(*where, gone.alias("gone"), come.alias("come"), moved.alias("moved"), F.filter(cells, lambda x: ~x["before"].eqNullSafe(x["after"])).alias("cells"))
    change = F.when(F.col("before").isNull(), "cell_added").when(F.col("after").isNull(), "cell_removed").otherwise("cell_changed")
    names = [c for c in rows.columns if c not in ("gone", "come", "moved", "cells")]
    changed = rows.select(*names, F.inline("cells")).withColumn("change", change)
    shifted = rows.where("moved").select(*names, F.lit(None).cast("string").alias("column_key"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"), F.lit("row_moved").alias("change"))
    return changed.unionByName(shifted)


def positional_diff(before: Table, after: Table) -> DataFrame:
    """(position, column_key, before, after, change) with rows paired by their place."""
    keys = [k for k in before.keys if k in after.keys]
    a, b = (t.df.select(POS, F.lit(True).alias("_there"), *[F.col(f"`{k}`") for k in keys]).alias(s) for t, s in ((before, "a"), (after, "b")))
    both = a.join(b, F.col(f"a.{POS}") == F.col(f"b.{POS}"), "full_outer")
    return _cells(both, [F.coalesce(f"a.{POS}", f"b.{POS}").alias("position")], keys, F.lit(False))


def keyed_diff(before: Table, after: Table, business_key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(differences, ambiguities) with rows paired by unique business keys.

    Differences have the key, column_key, before, after and change; ambiguities the side, the key and why
    rows of it are not compared: a part of it is missing, or several rows have it.
    """
    keys = [k for k in before.keys if k in after.keys]

    def side(t: Table, s: str) -> tuple[DataFrame, DataFrame]:
        blank = reduce(Column.__or__, [F.coalesce(F.col(f"`{k}`"), F.lit("")) == "" for k in business_key])
        n = t.df.withColumn("_blank", blank).groupBy(*[F.col(f"`{k}`") for k in business_key], "_blank").agg(F.count(F.lit(1)).alias("_n"))
        why = F.when(F.col("_blank"), "missing_business_key").when(F.col("_n") > 1, "duplicate_business_key")
        wrong = n.withColumn("code", why).where("code is not null").select(F.lit(s).alias("side"), *[F.col(f"`{k}`") for k in business_key], "code", F.col("_n").alias("n_rows"))
        one = n.where("not _blank and _n = 1").select(*[F.col(f"`{k}`") for k in business_key])
        rows = t.df.join(one, business_key, "left_semi").select(POS, F.lit(True).alias("_there"), *[F.col(f"`{k}`") for k in keys])
        return rows, wrong

    (a, wrong_a), (b, wrong_b) = side(before, "before"), side(after, "after")
    both = a.alias("a").join(b.alias("b"), reduce(Column.__and__, [_c("a", k) == _c("b", k) for k in business_key]), "full_outer")
    where = [F.coalesce(_c("a", k), _c("b", k)).alias(f"key_{k}") for k in business_key]
    moved = F.coalesce(F.col(f"a.{POS}") != F.col(f"b.{POS}"), F.lit(False))
    return _cells(both, where, [k for k in keys if k not in business_key] or keys, moved), wrong_a.unionByName(wrong_b)


#: What two revisions of a workbook can differ in, beside the cells and rows of their sheets.
PARTS = ("workbook_properties_changed", "sheet_order_changed", "style_catalog_changed", "sheet_added", "sheet_removed", "sheet_visibility_changed", "sheet_properties_changed", "row_properties_changed", "package_part_changed", "parser_settings_changed")


def workbook_diff(spark: SparkSession, before: str, after: str) -> DataFrame:
    """(name, change, sheet, before, after) of the workbooks and delimited files at two paths, paired by file name: what differs beside their cells.

    Each file is taken apart by one task into named properties with a text each; the properties meet in one join.
    """

    def taken(path: str) -> DataFrame:
        files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "content")
        return files.mapInArrow(_properties, "name string, kind string, sheet string, key string, value string")

    a, b = taken(before).withColumnRenamed("value", "before"), taken(after).withColumnRenamed("value", "after")
    on = ["name", "kind", "sheet", "key"]
    both = a.join(b, on, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    sheet = F.col("kind") == "sheet"
    change = F.when(sheet & F.col("before").isNull(), "sheet_added").when(sheet & F.col("after").isNull(), "sheet_removed").when(sheet, "sheet_visibility_changed").otherwise(F.concat("kind", F.lit("_changed")))
    # layout and rows of a sheet that is not on both sides are part of its coming or going
    gone = both.where(sheet & (F.col("before").isNull() | F.col("after").isNull())).select("name", "sheet").withColumn("_gone", F.lit(True))
    kept = both.join(F.broadcast(gone), ["name", "sheet"], "left").where(sheet | F.col("_gone").isNull())
    return kept.select("name", change.alias("change"), F.when(F.col("sheet") != "", F.col("sheet")).alias("sheet"), "before", "after")


def _properties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from ..sources.drafts import decoded, delimiter

    for b in batches:
        rows: list[tuple] = []
        for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if content[:2] == b"PK":
                rows += [(name, *p) for p in _workbook_properties(content)]
            else:
                text, issue = decoded(content)
                rows.append((name, "parser_settings", "", "delimiter", delimiter(text, name)[0] if text is not None else None))
                rows.append((name, "parser_settings", "", "encoding", issue or "utf"))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], names=["name", "kind", "sheet", "key", "value"])


def _workbook_properties(content: bytes) -> Iterator[tuple[str, str, str, str]]:
    """(kind, sheet, key, value) of a workbook: visibility, layout and rows of its sheets, order, styles, and checksums of all other parts."""
    from ..sources.drafts import _local, _relations, _safe_xml

    book = zipfile.ZipFile(io.BytesIO(content))
    root = ElementTree.fromstring(_safe_xml(book.read("xl/workbook.xml")))
    targets = _relations(book, "xl/workbook.xml")
    modeled = {"xl/workbook.xml", "xl/sharedStrings.xml", "xl/styles.xml", "[Content_Types].xml"}
    text = lambda node: ElementTree.canonicalize(ElementTree.tostring(node, encoding="unicode"), strip_text=True)
    order = []
    for node in root:
        if _local(node.tag) != "sheets":
            yield "workbook_properties", "", _local(node.tag), text(node)
            continue
        for s in node:
            name = s.get("name")
            order.append(name)
            yield "sheet", name, "state", s.get("state", "visible")
            _, part = next((targets[v] for k, v in s.attrib.items() if _local(k) == "id" and v in targets), ("", ""))
            if part not in book.namelist():
                continue
            modeled.add(part)
            for x in ElementTree.fromstring(_safe_xml(book.read(part))):
                if _local(x.tag) != "sheetData":
                    yield "sheet_properties", name, _local(x.tag), text(x)
                    continue
                for row in x:
                    own = sorted((k, v) for k, v in row.attrib.items() if k not in ("r", "spans"))
                    if own:
                        yield "row_properties", name, row.get("r"), str(own)
    yield "sheet_order", "", "order", str(order)
    if "xl/styles.xml" in book.namelist():
        yield "style_catalog", "", "styles", sha256(book.read("xl/styles.xml")).hexdigest()
    for part in sorted(set(book.namelist()) - modeled):
        if not part.endswith("/"):
            yield "package_part", "", part, sha256(book.read(part)).hexdigest()
