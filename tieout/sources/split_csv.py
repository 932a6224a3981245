"""Delimited text files of any size, each parsed by as many tasks as it has splits.

Whether a line begins inside a quoted cell depends on all lines before it. So a file is gone through twice.
First each split says, for both cases, how many records end in it and whether its end is inside a quoted
cell; these are functions of two states, and running them one after the other over a file's splits (a row
for each) tells how each split begins and the number of its first record. Then each split is parsed by
itself. Records that lie over several splits are put together from their parts.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from .drafts import BATCH, CELLS, SAMPLE, delimiter

#: States at the begin or end of a line: outside of quotes, inside, and after a fault, from where no line is read.
OUT, IN, FAULT = "out", "in", "fault"
BLANK = (b"\n", b"\r", b"\r\n")
#: Fixed value: bytes that Windows-1252 has no character for.
NO_CP1252 = bytes((0x81, 0x8D, 0x8F, 0x90, 0x9D))
#: Lines that are parsed together.
STEP = 256
#: A cell may be as long as this many characters.
LONGEST = (1 << 31) - 1
EXTENSIONS = (".csv", ".tsv", ".txt")


@cache
def _patterns(d: str) -> tuple[re.Pattern, re.Pattern]:
    """(whole, open): a line without its end that ends outside of quotes, and one that ends inside, both begun outside."""
    sep = re.escape(d.encode())
    cell = rb'(?:"[^"]*+(?:""[^"]*+)*+"(?=' + sep + rb'|\Z)|(?!")[^' + sep + rb"]*+)"
    return re.compile(cell + rb"(?:" + sep + cell + rb")*+\Z"), re.compile(rb"(?:" + cell + sep + rb')*+"[^"]*+(?:""[^"]*+)*+\Z')


def records(text: str, d: str) -> Iterator[list[str]]:
    csv.field_size_limit(LONGEST)
    return csv.reader(io.StringIO(text, newline=""), delimiter=d, strict=True)


def stepped(line: bytes, d: str, state: str) -> tuple[str, int, int]:
    """(state after the line, records that end with it: 0 or 1, those of them with cells)."""
    if b'"' not in line:
        return (state, 0, 0) if state != OUT else (OUT, 1, line not in BLANK)
    if state == FAULT:
        return FAULT, 0, 0
    body = line.rstrip(b"\r\n")
    if state == IN:
        body = b'"' + body  # inside of quotes is where a line is that begins with one
    whole, opened = _patterns(d)
    return (OUT, 1, 1) if whole.match(body) else (IN if opened.match(body) else FAULT, 0, 0)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line): the lines of delimited files as Spark's text reader splits them, those of one split in order."""
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    named = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    return named.where(F.lower("path").rlike(r"\.(csv|tsv|txt)$"))


def _ended(lines: list[bytes]) -> Iterator[bytes]:
    """Lines with their ends; a carriage return alone ends one too."""
    for line in lines:
        if b"\r" in line[:-1]:
            *first, rest = re.findall(rb"[^\r]*\r|[^\r]+", line)
            yield from first
            yield rest + b"\n"
        else:
            yield line + b"\n"


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[bytes], bool]]:
    """(all columns but line, lines, whether the block ends with them) of consecutive rows of one block."""
    held = None
    for b in batches:
        names = [n for n in b.schema.names if n != "line"]
        line, path, block = b.column("line"), b.column("path"), b.column("block") if "block" in names else None
        same = lambda i, j: path[i] == path[j] and (block is None or block[i] == block[j])  # noqa: B023, E731
        at, n = 0, b.num_rows
        while at < n:
            to = n if same(at, n - 1) else next(i for i in range(at + 1, n) if not same(at, i))
            key = tuple(b.column(c)[at].as_py() for c in names)
            if held is not None:
                yield held[0], held[1], held[0] != key
            held = (key, list(_ended(line.slice(at, to - at).to_pylist())))
            at = to
    if held is not None:
        yield held[0], held[1], True


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, line) of first splits -> (path, d, code, width, whole): how a file is read, or that it must be read whole."""
    text: list[bytes] = []
    size, wanted, done = 0, 4 * SAMPLE, False
    for (path,), lines, last in _by_block(batches):
        for line in () if done else lines:
            text.append(line)
            size += len(line)
            if size > wanted:
                done, wanted = not _head(path, text)[4], 2 * wanted
                if done:
                    break
        if last:
            yield pa.RecordBatch.from_pylist([dict(zip(HEAD.names, _head(path, text)))], HEAD)
            text, size, wanted, done = [], 0, 4 * SAMPLE, False


HEAD = pa.schema([("path", pa.string()), ("d", pa.string()), ("code", pa.string()), ("width", pa.int32()), ("whole", pa.bool_())])


def _head(path: str, lines: list[bytes]) -> tuple:
    raw = b"".join(lines)
    if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        return path, None, None, None, True
    text = raw.decode(errors="replace")
    d, code = delimiter(text, path)
    width = None
    try:
        width = next((len(r) for r in records(text, d) if r), 0)
    except csv.Error:
        pass
    return path, d, code, width, width is None


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, d, line) -> a row for each block: what it does to either state, and which encodings its bytes are in."""
    fresh = lambda: ({OUT: [OUT, 0, 0], IN: [IN, 0, 0]}, [True, True, False])
    states, kinds = fresh()
    for (path, block, d), lines, last in _by_block(batches):
        plain = blank = 0
        for line in [*lines, None]:
            if line is not None and b'"' not in line:
                plain += 1
                blank += line in BLANK
                continue
            for s in states.values():
                if s[0] == OUT:
                    s[1], s[2] = s[1] + plain, s[2] + plain - blank
                if line is not None:
                    s[0], more, full = stepped(line, d, s[0])
                    s[1], s[2] = s[1] + more, s[2] + full
            plain = blank = 0
        raw = b"".join(lines)
        kinds[1] = kinds[1] and len(raw.translate(None, NO_CP1252)) == len(raw)
        kinds[2] = kinds[2] or b"\0" in raw
        if kinds[0]:
            try:
                raw.decode()
            except UnicodeDecodeError:
                kinds[0] = False
        if last:
            yield pa.RecordBatch.from_pylist([dict(zip(SUM.names, (path, block, *states[OUT], *states[IN], *kinds)))], SUM)
            states, kinds = fresh()


SUM = pa.schema([("path", pa.string()), ("block", pa.int64()), *[(f"{s}_{k}", t) for s in (OUT, IN) for k, t in (("end", pa.string()), ("records", pa.int64()), ("rows", pa.int64()))], ("utf8", pa.bool_()), ("cp1252", pa.bool_()), ("nul", pa.bool_())])
PLACED = "path string, block long, state string, end string, first long, encoding string, lost long, code string, number long"


def _placed(group: pa.Table) -> pa.Table:
    """The blocks of one file -> how each begins and ends and the number of its first record; and the file's issues."""
    blocks = group.sort_by("block").to_pylist()
    path = blocks[0]["path"]
    out: list[dict] = []
    issue = lambda code, number: out.append({"path": path, "code": code, "number": number})
    utf8 = all(b["utf8"] for b in blocks)
    encoding = "utf-8" if utf8 else "cp1252"
    refused = "unsupported_encoding" if not utf8 and not all(b["cp1252"] for b in blocks) else "invalid_text" if any(b["nul"] for b in blocks) else None
    if refused:
        issue(refused, 0)
    else:
        if not utf8:
            issue("encoding_assumed", 0)
        state, ended, rows = OUT, 0, 0
        for b in blocks:
            if state != FAULT:
                end = b[f"{state}_end"]
                out.append({"path": path, "block": b["block"], "state": state, "end": end, "first": ended, "encoding": encoding})
                ended, rows, state = ended + b[f"{state}_records"], rows + b[f"{state}_rows"], end
        for row in out:  # the record that a fault or the file's end leaves open
            row["lost"] = ended if state != OUT else -1
        if state != OUT:
            issue("malformed_csv", rows)
        if not rows:
            issue("no_tabular_content", 0)
        if ended > rows:
            issue("blank_records", ended - rows)
    names = [part.split()[0] for part in PLACED.split(", ")]
    kinds = dict.fromkeys(("block", "first", "lost", "number"), pa.int64())
    return pa.Table.from_pylist(out, pa.schema([(n, kinds.get(n, pa.string())) for n in names]))


KINDS = {"row": pa.int64(), "column": pa.int32(), "hidden": pa.bool_()}
NAMES = [part.split()[0] for part in CELLS.split(", ")]


class Cells:
    """Cells and issues of a file's records, gathered by column."""

    def __init__(self, path: str, width: int):
        self.path, self.width = path, width
        self.rows: list[int] = []
        self.columns: list[int] = []
        self.values: list[str] = []
        self.ragged: list[int] = []

    def take(self, first: int, found: Iterator[list[str]]) -> int:
        """Adds records, the first of which has the number first + 1, up to a fault; returns the number of the last."""
        number = first
        try:
            for number, record in enumerate(found, first + 1):
                n = len(record)
                self.rows += [number] * n
                self.columns += range(1, n + 1)
                self.values += record
                if n and n != self.width:
                    self.ragged.append(number)
        except csv.Error:
            pass
        return number

    def batch(self) -> pa.RecordBatch:
        n, more = len(self.rows), len(self.ragged)
        both = lambda cell, issue: pa.concat_arrays([cell, issue])
        text = lambda value, n: pa.repeat(pa.scalar(value, pa.string()), n)
        known = {
            "path": text(self.path, n + more), "kind": both(text("cell", n), text("issue", more)), "sheet": text("", n + more), "row": pa.array(self.rows + self.ragged, pa.int64()),
            "column": both(pa.array(self.columns, pa.int32()), pa.nulls(more, pa.int32())), "value": both(pa.array(self.values, pa.string()), pa.nulls(more, pa.string())),
            "hidden": both(pa.repeat(pa.scalar(False), n), pa.nulls(more, pa.bool_())), "code": both(pa.nulls(n, pa.string()), text("ragged_row", more)),
        }
        return pa.RecordBatch.from_arrays([known.get(k, pa.nulls(n + more, KINDS.get(k, pa.string()))) for k in NAMES], names=NAMES)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, d, width, state, first, encoding, lost, line) -> CELLS of the records that begin and end in a block."""
    state = None
    for (path, block, d, width, begin, first, encoding, lost), lines, last in _by_block(batches):
        held = Cells(path, width)
        if state is None:
            state, number, over, buffer, whole = begin, first, begin == IN, [], 0
        for line in lines:
            if state == FAULT:
                break
            state, ended, _ = stepped(line, d, state)
            if over:  # a record that an earlier block began
                over, number = state == IN, number + ended
                continue
            buffer.append(line)
            if state != IN:
                whole = len(buffer)
            if whole == len(buffer) >= STEP:
                number = held.take(number, records(_text(buffer, encoding), d))
                buffer, whole = [], 0
                if len(held.rows) >= BATCH:
                    yield held.batch()
                    held = Cells(path, width)
        if last:
            held.take(number, records(_text(buffer[:whole], encoding), d))
            state = None
        if held.rows:
            yield held.batch()


def _text(lines: list[bytes], encoding: str) -> str:
    return b"".join(lines).decode(encoding)


PART = pa.schema([("path", pa.string()), ("record", pa.int64()), ("block", pa.int64()), ("text", pa.string()), ("d", pa.string()), ("width", pa.int32())])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of records that lie over several blocks; record counts those that end before."""
    state = None
    for (path, block, d, width, begin, first, encoding, lost), lines, last in _by_block(batches):
        if state is None:
            state, ended, buffer, over = begin, first, [], begin == IN
        part = lambda: pa.RecordBatch.from_pylist([dict(zip(PART.names, (path, ended, block, _text(buffer, encoding), d, width)))], PART)  # noqa: B023, E731
        for line in lines:
            before = state
            state, more, _ = stepped(line, d, state)
            if ended != lost:
                if before != IN:
                    buffer = []
                buffer.append(line)
                if over and state != IN:
                    yield part()
            over = over and state == IN
            ended += more
        if last:
            if state == IN and ended != lost:
                yield part()
            state = None


def _joined(group: pa.Table) -> pa.Table:
    """The parts of one record -> its CELLS."""
    parts = group.sort_by("block").to_pylist()
    held = Cells(parts[0]["path"], parts[0]["width"])
    held.take(parts[0]["record"], records("".join(p["text"] for p in parts), parts[0]["d"]))
    return pa.Table.from_batches([held.batch()])


def read_split_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(CELLS of the delimited files at path, paths of those that must be read whole).

    The same cells, numbers and issues as one task would give that reads a file from its begin to its end:
    quoted cells may hold delimiters and line ends, a carriage return alone ends a line too, empty lines are
    counted, records with another number of cells than the first are reported, and after a fault nothing
    more is read (a record that is still open at the end of the file is not gathered). UTF-8, else Windows-1252, which is reported; files in UTF-16, and those whose first record
    is longer than a split, must be read whole. sha256 is null here. What is broadcast is a row of about 150
    bytes for each split (spark.sql.files.maxPartitionBytes). Files without a byte are not listed by Spark and give no row.
    """
    lines = lines_of(spark, path)
    heads = checkpointed(lines.where("block = 0").select("path", "line").mapInArrow(_heads, "path string, d string, code string, width int, whole boolean"))
    split = F.broadcast(heads.where("not whole").select("path", "d", "width"))
    sums = lines.join(split.select("path", "d"), "path").select("path", "block", "d", "line").mapInArrow(_summed, "path string, block long, " + ", ".join(f"{s}_end string, {s}_records long, {s}_rows long" for s in (OUT, IN)) + ", utf8 boolean, cp1252 boolean, nul boolean")
    placed = checkpointed(sums.groupBy("path").applyInArrow(_placed, PLACED))
    blocks = placed.where("block is not null").join(split, "path")
    to_read = lambda b: lines.join(F.broadcast(b.select("path", "block", "d", "width", "state", "first", "encoding", "lost")), ["path", "block"]).select("path", "block", "d", "width", "state", "first", "encoding", "lost", "line")
    out = to_read(blocks).mapInArrow(_parsed, CELLS)
    over = blocks.where(f"state = '{IN}' or end = '{IN}'")
    if over.take(1):
        parts = to_read(over).mapInArrow(_parts, "path string, record long, block long, text string, d string, width int")
        out = out.unionByName(parts.groupBy("path", "record").applyInArrow(_joined, CELLS))
    refused = placed.where("code in ('unsupported_encoding', 'invalid_text')").select("path")
    codes = placed.where("code is not null").select("path", "code", "number")
    codes = codes.unionByName(heads.where("not whole and code is not null").join(refused, "path", "left_anti").select("path", "code", F.lit(0).cast("long").alias("number")))
    none = {n: F.lit(None).cast(t) for n, t in (p.split() for p in CELLS.split(", "))}
    issues = codes.select(*[{"path": F.col("path"), "kind": F.lit("issue"), "sheet": F.lit(""), "row": F.col("number"), "code": F.col("code")}.get(n, c).alias(n) for n, c in none.items()])
    return out.unionByName(issues), heads.where("whole").select("path")
