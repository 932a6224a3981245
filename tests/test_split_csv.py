"""Delimited files parsed by splits against one task that parses them from begin to end."""

import random

import pyarrow as pa
import pytest

from tieout.sources import drafts, split_csv

KEYS = ("kind", "row", "column", "value", "code")


def one_task(path, content):
    rows = [dict(zip([n for n in split_csv.NAMES if n not in ("path", "sha256")], x)) for x in drafts._draft(path, content)]
    return sorted((tuple(r[k] for k in KEYS) for r in rows), key=str)


def contents():
    rng = random.Random(11)
    cells = ["", "a", "12.5", "é", '"', '""', "x y", "two\nlines", "a\rb", "c\r\nd", 'say ""hi""', "semi;colon", "tab\there", "日", " " * 9]
    out = {
        "plain.csv": b"a,b\n1,2\n3,4\n", "no_end.csv": b"a,b\n1,2", "bom.csv": "﻿\"id\",x\r\n1,2\r\n".encode(), "blank.csv": b"\n\r\n\n", "open.csv": b'name,value\nA,1\n"unterminated\nmore\nand more,1\n',
        "fault.csv": b'a,b\n1,2\n"x"y,3\n4,5\n', "stray.csv": b'a,b\n1"2,3\n4,5"\n"6",7\n', "latin.csv": "Name;Value\nCrème;1\n".encode("cp1252"), "refused.csv": b"a,b\n\x81,\xff\n", "nul.csv": b"a,b\n1,\x00\n", "tabs.tsv": b"a\tb\n1\t2\n",
        "cr.txt": b"a|b\rc|d\r\re|f\r", "quoted.csv": b'"a","b"\n"1\n\n\n","2"\n\n"3","""\n"""\n', "ragged.csv": b"name,value\nA,1,extra\nB\n,\n", "wide.csv": b"a,b\n" + b'"' + b"long\n" * 40 + b'",x\n1,2\n',
    }
    for i in range(12):
        d = rng.choice(",;\t|")
        end = rng.choice(["\n", "\r\n", "\r"])
        lines = []
        for _ in range(rng.randint(2, 60)):
            row = [rng.choice(cells) for _ in range(4)]
            lines.append(d.join('"' + c.replace('"', '""') + '"' if rng.random() < 0.5 or set(c) & {'"', "\n", "\r", d} else c for c in row))
            lines += [""] * (rng.random() < 0.1)
        out[f"r{i}.csv"] = (end.join(lines) + end * rng.randint(0, 2)).encode()
        if i % 4 == 3:  # torn at any place
            out[f"r{i}.csv"] = out[f"r{i}.csv"][: rng.randrange(len(out[f"r{i}.csv"]))]
    return out


@pytest.mark.parametrize("size", [61, 1 << 20])
def test_same_cells_at_every_split_size(spark, tmp_path, size):
    files = contents()
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, size)
        cells, whole = split_csv.read_split_csv(spark, str(tmp_path))
        got: dict[str, list] = {}
        for r in cells.collect():
            got.setdefault(r.path.rpartition("/")[2], []).append(tuple(r[k] for k in KEYS))
        left = {r.path.rpartition("/")[2] for r in whole.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name, content in files.items():
        if name not in left:
            assert sorted(got.get(name, []), key=str) == one_task(name, content), name
    assert not left if size == 1 << 20 else "plain.csv" not in left


def by_hand(path, content, rng):
    """The steps of the reader over a file cut into blocks between any two lines."""
    lines = content.removeprefix(b"\xef\xbb\xbf").split(b"\n")
    lines = lines[:-1] if not lines[-1] else lines
    ends = sorted(rng.sample(range(1, len(lines)), rng.randint(0, len(lines) - 1)))
    blocks = list(zip([0, *ends], [*ends, len(lines)]))
    batch = lambda names, rows: [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + 7]]) for i in range(0, len(rows), 7)]
    head = next(split_csv._heads(iter(batch(("path", "line"), [(path, x) for x in lines[: blocks[0][1]]])))).to_pylist()[0]
    if head["whole"]:
        return None
    d, width = head["d"], head["width"]
    rows = [(path, a, d, x) for a, b in blocks for x in lines[a:b]]
    sums = pa.Table.from_batches(split_csv._summed(iter(batch(("path", "block", "d", "line"), rows))))
    placed = split_csv._placed(sums).to_pylist()
    out = [("issue", p["number"], None, None, p["code"]) for p in placed if p["code"]]
    if head["code"] and not {"unsupported_encoding", "invalid_text"} & {o[4] for o in out}:
        out.append(("issue", 0, None, None, head["code"]))
    names = ("path", "block", "d", "width", "state", "first", "encoding", "lost", "line")
    rows = [(path, p["block"], d, width, p["state"], p["first"], p["encoding"], p["lost"], x) for a, b in blocks for p in placed if p["block"] == a for x in lines[a:b]]
    cells = list(split_csv._parsed(iter(batch(names, rows)))) if rows else []
    parts = [r for b in split_csv._parts(iter(batch(names, rows))) for r in b.to_pylist()] if rows else []
    for record in {r["record"] for r in parts}:
        cells += split_csv._joined(pa.Table.from_pylist([r for r in parts if r["record"] == record], split_csv.PART)).to_batches()
    return sorted(out + [tuple(r[k] for k in KEYS) for b in cells for r in b.to_pylist()], key=str)


def test_same_cells_in_any_blocks():
    rng, seen = random.Random(5), 0
    for name, content in contents().items():
        want = one_task(name, content)
        for _ in range(25):
            got = by_hand(name, content, rng)
            assert got in (None, want), name
            seen += got is not None
    assert seen > 400


def test_lines_step_as_the_parser_does():
    rng = random.Random(2)
    for _ in range(4000):
        body = "".join(rng.choice('a",;') for _ in range(rng.randint(0, 9)))
        for state in (split_csv.OUT, split_csv.IN):
            text = ('"' if state == split_csv.IN else "") + body
            try:
                end = split_csv.OUT if list(split_csv.records(text + "\n", ",")) is not None else None
            except split_csv.csv.Error as e:
                end = split_csv.IN if "unexpected end" in str(e) else split_csv.FAULT
            assert split_csv.stepped(body.encode() + b"\n", ",", state)[0] == end, (text, state)
