"""Draft tables out of captured responses of a document parser: blocks of HTML, Markdown or plain text, with their place on the page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESPONSE = """struct<model_version: string, result: struct<type: string, chunks: array<struct<blocks: array<struct<
type: string, content: string, confidence: string, granular_confidence: string, bbox: struct<left: double, top: double, width: double, height: double, page: int, original_page: int>>>>>>>"""
CELLS = "source string, block long, structure string, row long, column int, rowspan int, colspan int, value string, page int, original_page int, bbox array<double>, code string"
#: Largest table.
MOST_COLUMNS, MOST_ROWS = 1024, 250_000


class _Events(HTMLParser):
    """A page as a list of (what, value): 'open' and 'close' of table, tr and cell, and 'text' inside cells."""

    KINDS = {"table": "table", "tr": "row", "td": "cell", "th": "cell"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, dict]] = []
        self.mute = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.mute += 1
        elif not self.mute and tag in self.KINDS:
            self.events.append(("open", self.KINDS[tag], dict(attrs)))
        elif not self.mute and tag == "br":
            self.events.append(("text", "\n", {}))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        elif not self.mute and tag in self.KINDS:
            self.events.append(("close", self.KINDS[tag], {}))

    def handle_data(self, data):
        if not self.mute:
            self.events.append(("text", data, {}))


def _nested(events: list[tuple[str, str, dict]]) -> list[list[tuple[str, int, int]]]:
    """Rows of (text, rowspan, colspan); ValueError where tables nest or rows and cells don't."""
    rows: list[list[tuple[str, int, int]]] = []
    path: list[str] = []
    inside = {"row": "table", "cell": "row"}
    text, span = "", (1, 1)
    for what, value, attrs in events:
        if what == "text":
            text += value if path[-1:] == ["cell"] else ""
        elif what == "open":
            if (path[-1] if path else None) != inside.get(value):
                raise ValueError("wrong nesting")
            path.append(value)
            if value == "row":
                rows.append([])
            elif value == "cell":
                text, span = "", (int(attrs.get("rowspan") or 1), int(attrs.get("colspan") or 1))
                if not 1 <= span[0] <= MOST_ROWS or not 1 <= span[1] <= MOST_COLUMNS:
                    raise ValueError("span out of range")
        elif path and path[-1] == value:
            path.pop()
            if value == "cell":
                rows[-1].append((text, *span))
        elif value in path:
            raise ValueError("unclosed part")
    if path or not rows:
        raise ValueError("incomplete table")
    return rows


def placed(rows: list[list[tuple[str, int, int]]]) -> Iterator[tuple[int, int, int, int, str]]:
    """(row, column, rowspan, colspan, text) from 1 on: each cell at the first place that no span covers; a value is given once."""
    until: dict[int, int] = {}  # column -> first row that no span from above covers
    for r, row in enumerate(rows, 1):
        c = 1
        for text, down, across in row:
            while until.get(c, 0) > r:
                c += 1
            if any(until.get(k, 0) > r for k in range(c, c + across)) or c + across - 1 > MOST_COLUMNS:
                raise ValueError("spans overlap")
            until.update(dict.fromkeys(range(c, c + across), r + down))
            yield r, c, down, across, text
            c += across


def _split(line: str) -> list[str]:
    """The cells of a line of a Markdown table; an escaped bar is text."""
    cells = [c.strip().replace(r"\|", "|") for c in re.split(r"(?<!\\)\|", line.strip())]
    return cells[(cells[:1] == [""]) : len(cells) - (len(cells) > 1 and cells[-1] == "")]


def markdown_rows(text: str) -> list[list[tuple[str, int, int]]] | None:
    """The rows of a Markdown table without its line of dashes, or None if text is none."""
    lines = text.splitlines()
    if len(lines) < 2 or "|" not in lines[0] or not (dashes := _split(lines[1])) or not all(re.fullmatch(":?-{3,}:?", d) for d in dashes):
        return None
    return [[(c, 1, 1) for c in _split(line)] for i, line in enumerate(lines) if i != 1 and line.strip()]


def block_cells(content: str) -> tuple[str, list[tuple[int, int, int, int, str]], str | None]:
    """(structure, cells, issue) of a block's text: a table where it can be told, else the text as one cell."""
    try:
        if re.search(r"<table[\s>]", content, re.IGNORECASE):
            page = _Events()
            page.feed(content)
            page.close()
            return "html", list(placed(_nested(page.events))), None
        if (rows := markdown_rows(content)) is not None:
            return "markdown", list(placed(rows)), None
    except ValueError:
        return "text", [(1, 1, 1, 1, content)], "table_unresolved"
    return "text", [(1, 1, 1, 1, content)], None


def box(b: Column) -> Column:
    """left, top, right, bottom in parts of the page, or null where they aren't."""
    right, bottom = b["left"] + b["width"], b["top"] + b["height"]
    fine = (b["left"] >= 0) & (b["top"] >= 0) & (b["width"] > 0) & (b["height"] > 0) & (right <= 1) & (bottom <= 1) & (b["page"] >= 1) & (b["original_page"] >= 1)
    return F.when(fine, F.array(b["left"], b["top"], right, bottom))


def response_blocks(responses: DataFrame, source: str = "source", body: str = "response", declared: str | None = None) -> DataFrame:
    """(source, block, type, content, confidence, page, original_page, bbox, code): the blocks of each captured response, or why there are none.

    body is a response's JSON text. declared names a column with the SHA-256 that it must have.
    """
    parsed = responses.select(F.col(source).cast("string").alias("source"), F.from_json(F.col(body), RESPONSE).alias("r"), (F.sha2(F.col(body), 256) == F.col(declared) if declared else F.lit(True)).alias("same"))
    full = F.coalesce(F.col("r.result.type") == "full", F.lit(False))
    blocks = F.flatten(F.col("r.result.chunks.blocks"))
    code = F.when(~F.col("same"), "response_mismatch").when(~full | (F.coalesce(F.size(blocks), F.lit(0)) <= 0), "malformed_response")
    bad = parsed.withColumn("code", code)
    nothing = lambda t: F.lit(None).cast(t)
    lost = bad.where("code is not null").select("source", nothing("long").alias("block"), *[nothing("string").alias(n) for n in ("type", "content", "confidence")], nothing("int").alias("page"), nothing("int").alias("original_page"), nothing("array<double>").alias("bbox"), "code")
    rows = bad.where("code is null").select("source", F.posexplode(blocks).alias("block", "b"))
    place = box(F.col("b.bbox"))
    fine = rows.select(
        "source", F.col("block").cast("long").alias("block"), "b.type", "b.content", "b.confidence", F.when(place.isNotNull(), F.col("b.bbox.page")).alias("page"), F.when(place.isNotNull(), F.col("b.bbox.original_page")).alias("original_page"),
        place.alias("bbox"), F.when(F.col("b.content").isNull(), "content_missing").when(place.isNull(), "citation_missing").alias("code"),
    )
    return lost.unionByName(fine)


def draft_blocks(responses: DataFrame, source: str = "source", body: str = "response", declared: str | None = None) -> DataFrame:
    """CELLS: a row for each cell of each block of captured responses, each with its block's box, and one for each issue. No network is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string()]
        names = [part.split()[0] for part in CELLS.split(", ")]
        for b in batches:
            rows: list[tuple] = []
            for r in b.to_pylist():
                place = (r["page"], r["original_page"], r["bbox"])
                if r["code"]:
                    rows.append((r["source"], r["block"], None, None, None, None, None, None, *place, r["code"]))
                if r["content"] is None:
                    continue
                structure, cells, issue = block_cells(r["content"])
                if issue:
                    rows.append((r["source"], r["block"], None, None, None, None, None, None, *place, issue))
                rows += [(r["source"], r["block"], structure, row, column, down, across, value, *place, None) for row, column, down, across, value in cells]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)

    return response_blocks(responses, source, body, declared).mapInArrow(run, CELLS)
