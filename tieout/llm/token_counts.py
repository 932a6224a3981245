"""Token counts of whole texts under a byte-level BPE vocabulary.

Most pre-tokens of real text are themselves vocabulary strings. Before any text is read, each
vocabulary string is merged on its own; those that come out as one token form the shortcut table.
A pre-token found there counts one. Only the others are merged.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split pattern of byte-level BPE, and the printable stand-ins of its 256 bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
STAND_INS = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}

#: The same split for texts of characters below U+0250 alone, whose categories can be spelt out: the re module is faster.
LOW = {k: "".join(c for c in map(chr, range(0x250)) if regex.match(p, c)) for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))}
LOW_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+".format_map({k: re.escape(v) for k, v in LOW.items()}))
NOT_LOW = re.compile("[^\0-\u024f]")

#: In a count, tokens are below this and pre-tokens found in the shortcut table above.
WHOLE = 1 << 32
#: Longest pre-token that is remembered, and how many are.
KEEP_CHARS, KEEP = 48, 700_000


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The symbols after all merges, lowest rank first, leftmost among equals. Changes symbols."""
    if len(symbols) > 48:
        return _merged_long(symbols, ranks)
    get, none = ranks.get, 1 << 60
    found = [get(p, none) for p in zip(symbols, symbols[1:])]
    while found and (best := min(found)) != none:
        i = found.index(best)
        symbols[i] += symbols.pop(i + 1)
        del found[i]
        if i < len(found):
            found[i] = get((symbols[i], symbols[i + 1]), none)
        if i:
            found[i - 1] = get((symbols[i - 1], symbols[i]), none)
    return symbols


def _merged_long(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same by a heap over a linked list: n log n for pre-tokens of any length."""
    s: list[str | None] = list(symbols)
    n = len(s)
    after, ahead = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(p)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if s[i] != pair[0] or j < 0 or s[j] != pair[1]:
            continue
        s[i], s[j] = pair[0] + pair[1], None
        after[i] = k = after[j]
        if k >= 0:
            ahead[k] = i
            if (r := ranks.get(p := (s[i], s[k]))) is not None:
                heapq.heappush(heap, (r, i, p))
        if (h := ahead[i]) >= 0 and (r := ranks.get(p := (s[h], s[i]))) is not None:
            heapq.heappush(heap, (r, h, p))
    return [x for x in s if x is not None]


class Vocabulary(dict):
    """Pre-token -> tokens (+ WHOLE if it is a whole token); merges and remembers those not met before."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"])
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.any_split = regex.compile(SPLIT)
        self.specials = [t["content"] for t in model.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        back = {c: b for b, c in STAND_INS.items()}
        self.whole: dict[str, int] = {}
        for token in model["model"]["vocab"]:
            try:
                text = bytes(back[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # not a text, so no pre-token either
            if merged(list(token), self.ranks) == [token] and self.split(text) == [text]:
                self.whole[text] = WHOLE + 1
        super().__init__(self.whole)

    def __missing__(self, piece: str) -> int:
        n = len(merged(list(piece.encode().decode("latin-1").translate(STAND_INS)), self.ranks))
        if len(piece) <= KEEP_CHARS:
            if len(self) >= KEEP + len(self.whole):
                self.clear()
                self.update(self.whole)
            self[piece] = n
        return n

    def split(self, text: str) -> list[str]:
        return (self.any_split if NOT_LOW.search(text) else LOW_SPLIT).findall(text)

    def count(self, text: str) -> tuple[int, int]:
        """Tokens of text, and how many of them are pre-tokens taken from the shortcut table."""
        if self.special is not None and any(s in text for s in self.specials):
            parts = self.special.split(text)
            total = len(parts) - 1 + sum(sum(map(self.__getitem__, self.split(p))) for p in parts)
        else:
            total = sum(map(self.__getitem__, self.split(text)))
        return total % WHOLE, total // WHOLE


@cache
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker."""
    return Vocabulary(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_whole): one row for each row of docs, no shuffle.

    The counts are those of the tokenizers library for the vocabulary at path without post-processing,
    truncation or padding; an added token's string in a text is that token. n_whole are the pre-tokens
    that the shortcut table answered. A null or empty text has no bytes and no tokens; texts of any
    length are counted whole; repeated rows and null ids each keep their row; other columns are
    ignored; an empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            found = [v.count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([n for n, _ in found], pa.int64()), pa.array([w for _, w in found], pa.int64())], names=["id", "n_bytes", "n_tokens", "n_whole"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, n_whole long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_whole")
