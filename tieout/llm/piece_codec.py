"""Encoding and decoding with a merge-type (BPE) sentencepiece vocabulary.

Encoding finds, without replaying the merges of a text, the one segmentation that they give. A list
of pieces is that segmentation exactly when each two neighbours, merged anew from their characters,
come out as these two pieces. So the encoder goes through the text with the longest piece that starts
at each place (all matches come from one pass of an Aho-Corasick automaton), takes the next shorter
one where neighbours do not agree, and steps back where none is left, noting in a bitfield the places
from which no way led on, so that it never tries them again.

No merge joins two characters that stand side by side in no piece. So a text falls apart there, above
all before each space mark, and the parts are encoded one by one, the ids of frequent ones remembered.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Longest word whose ids are remembered; how many are; how many neighbour checks are.
KEEP_CHARS, KEEP, KEEP_PAIRS = 48, 600_000, 600_000
#: Ids that a task gathers before it passes their rows on.
PASSED_ON = 1 << 20


class PieceEncoder(dict):
    """Word (with its space marks) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.piece = {i: p.id_to_piece(i) for i in kept}
        self.id = {s: i for i, s in self.piece.items()}
        self.rank = {s: -p.get_score(i) for i, s in self.piece.items()}
        self.byte = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end = p.bos_id(), p.eos_id()
        if any(SPACE in s.lstrip(SPACE) for s in self.id):
            raise ValueError("a piece has a space mark after another character: words can't be encoded one by one")
        if any(c not in self.id for s in self.id for c in s):
            raise ValueError("a piece has a character that is no piece itself")
        self.automaton = ahocorasick.Automaton()
        for s, i in self.id.items():
            self.automaton.add_word(s, i << 8 | len(s))
        self.automaton.make_automaton()
        self.words = re.compile(f"{SPACE}+[^{SPACE}]*")
        self.joined = {s[i : i + 2] for s in self.id for i in range(len(s) - 1)}
        self.agreed: dict[tuple[int, int], bool] = {}

    def remerged(self, text: str) -> list[str]:
        """The pieces that merging gives: best score first, leftmost among equals."""
        symbols, rank, none = list(text), self.rank, float("inf")
        found = [rank.get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while found and (best := min(found)) != none:
            i = found.index(best)
            symbols[i] += symbols.pop(i + 1)
            del found[i]
            if i < len(found):
                found[i] = rank.get(symbols[i] + symbols[i + 1], none)
            if i:
                found[i - 1] = rank.get(symbols[i - 1] + symbols[i], none)
        return symbols

    def agree(self, a: int, b: int) -> bool:
        if (known := self.agreed.get((a, b))) is None:
            if len(self.agreed) >= KEEP_PAIRS:
                self.agreed.clear()
            left, right = self.piece[a], self.piece[b]
            known = self.agreed[a, b] = self.remerged(left + right) == [left, right]
        return known

    def segmented(self, text: str) -> list[int]:
        """Ids of a text by backtracking; each two neighbouring characters of it stand side by side in some piece."""
        n = len(text)
        if (whole := self.id.get(text)) is not None and n == 1:
            return [whole]
        at: list[list[int]] = [[] for _ in text]
        for end, match in self.automaton.iter(text):
            at[end + 1 - (match & 255)].append(match)  # ends rise, so the longest match comes last
        ids: list[int] = []
        way: list[int] = []  # how many shorter matches were left with each piece taken
        agreed, last = self.agreed, -1
        dead = 0  # bit i: no way on from place i
        pos, left = 0, len(at[0])
        while pos < n:
            matches = at[pos]
            while left:
                left -= 1
                match = matches[left]
                end = pos + (match & 255)
                if not dead >> end & 1:
                    piece = match >> 8
                    if last < 0:
                        break
                    if (known := agreed.get((last, piece))) is None:
                        known = self.agree(last, piece)
                    if known:
                        break
            else:
                dead |= 1 << pos
                pos -= len(self.piece[ids.pop()])
                left = way.pop()
                last = ids[-1] if ids else -1
                continue
            ids.append(piece)
            way.append(left)
            last, pos = piece, end
            left = len(at[pos]) if pos < n else 0
        return ids

    def __missing__(self, word: str) -> bytes:
        if word.lstrip(SPACE).isalpha() and all(map(self.id.__contains__, word)):
            return self.kept(word, array("I", self.segmented(word)).tobytes())
        joined = self.joined
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joined), len(word)]
        if len(cuts) > 2:
            packed = b"".join([self[word[i:j]] for i, j in zip(cuts, cuts[1:])])
        elif len(word) == 1 and word not in self.id:
            packed = array("I", [self.byte[b] for b in word.encode()]).tobytes()
        else:
            packed = array("I", self.segmented(word)).tobytes()
        return self.kept(word, packed)

    def kept(self, word: str, packed: bytes) -> bytes:
        if len(word) <= KEEP_CHARS:
            if len(self) >= KEEP:
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids of text, begin and end included, as little-endian unsigned 32-bit integers."""
        words = self.words.findall(SPACE + text.replace(" ", SPACE)) if text else ()
        return b"".join((array("I", [self.begin]).tobytes(), *map(self.__getitem__, words), array("I", [self.end]).tobytes()))

    def decode(self, packed: bytes) -> str:
        return self.library.decode(array("I", packed).tolist())


@cache
def encoder(path: str) -> PieceEncoder:
    """One for each Python worker."""
    return PieceEncoder(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256 [, ids, decoded]): one row for each row of docs, no shuffle.

    ids are those of the sentencepiece library with begin and end ids and no sampling; decoded is its
    text for them. keep adds both themselves. A null or empty text has the two outer ids alone and
    decodes to the empty text; characters without a piece become bytes; texts of any length are encoded
    whole; repeated rows and null ids each keep their row; other columns are ignored; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            first, held, packed, texts = 0, 0, [], []
            n, ids_sha, text_sha = [], [], []
            for i, t in enumerate(b.column(1), 1):
                ids = e.encode(t.as_py() or "")
                text = e.decode(ids)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                if keep:
                    packed.append(ids)
                    texts.append(text)
                held += n[-1]
                if held >= PASSED_ON or i == b.num_rows:
                    columns = [b.column(0).slice(first, i - first), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if keep:
                        ends = pa.array(np.cumsum([0, *n]), pa.int32())
                        columns += [pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), "<i4"))), pa.array(texts, pa.string())]
                        names += ["ids", "decoded"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    first, held, packed, texts = i, 0, [], []
                    n, ids_sha, text_sha = [], [], []

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep)
    return out.withColumnRenamed("id", id_col)
