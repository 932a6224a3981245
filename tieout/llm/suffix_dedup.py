"""Removal of byte strings that the corpus already has, by sparse suffix sorting with hashed comparisons.

A full suffix array has an entry for each byte. Here only some suffixes stand for all: each string of
`length` bytes picks its gram of GRAM bytes with the least hash, so strings that are equal pick the same
gram at the same place. The neighbouring strings that pick one gram form a block, about one for each 40
bytes. Blocks of one gram are brought together. Blocks that are alike as a whole, by the BLAKE2b digest of
their bytes, need no further look: all but the first repeat. Where a gram has blocks that differ, as at the
ends of a repeated passage, the suffixes after and before the gram are sorted by a merge sort whose
comparisons find the common extension by binary search over prefix polynomial hashes; the extensions of
neighbours are then checked against the bytes. Strings at one place beside the gram are equal where they
stand in one run of both orders with long enough common extensions. Where more blocks share a gram than one
task shall sort, each block is halved: the strings of either half have a longer core in common than the
gram, and the cores part the blocks; this goes on down to single strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, may_have

GRAM = 24
#: Bytes that are hashed at once; places in such a part have PLACE_BITS bits.
PART, PLACE_BITS = 1 << 19, 20
#: Blocks of one gram that one task sorts at most; more are halved.
SORTED = 1 << 12
#: A gram is frequent from so many blocks on, and from one in so many of all; those of a batch are counted from OFTEN on.
FREQUENT, SHARE, OFTEN = 1 << 12, 1 << 12, 8
#: Tasks over which the blocks of a frequent gram are spread.
SPREAD = 64
BASE = 0x9E3779B97F4A7C15


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i up to 2 ** bits."""
    n = (1 << bits) + 1
    return tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64), dtype=np.uint64))) for b in (BASE, pow(BASE, -1, 1 << 64)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Prefixes:
    """Polynomial hashes of all prefixes of x, and from them of any part of it."""

    def __init__(self, x: np.ndarray):
        self.power, self.inverse = _powers(max(PLACE_BITS, len(x).bit_length()))
        self.h = np.concatenate((np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.power[: len(x)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.h[end] - self.h[start]) * self.inverse[start]


def blocks_of(x: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(gram hash, first string, last string, gram) of the blocks in x, several texts that end at ends."""
    n = len(x)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    prefix = Prefixes(x)
    grams = np.arange(n - GRAM + 1)
    g = _mix(prefix.of(grams, grams + GRAM))
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (g & ~low) | grams.astype(np.uint64)
    width, have = length - GRAM + 1, 1
    while have < width:  # the least of `have` neighbours, doubled until it is that of all grams in a string
        by = min(have, width - have)
        least = np.minimum(least[: len(least) - by], least[by:])
        have += by
    at = (least & low).astype(np.int64)  # of each string its gram
    text = np.searchsorted(ends, np.arange(len(at)), side="right")
    inside = np.arange(len(at)) + length <= ends[text]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    first = np.nonzero(new)[0]
    last = np.append(first[1:] - 1, len(at) - 1)
    fine = inside[first]
    first, last = first[fine], last[fine]
    gram = at[first]
    return g[gram].view(np.int64), first, last, gram


def digests(data: bytes, start: np.ndarray, end: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b for each data[start:end] and what else makes blocks differ, as two numbers."""
    view = memoryview(data)
    joined = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())])
    two = np.frombuffer(joined, "<i8").reshape(-1, 2)
    return two[:, 0] ^ shape, two[:, 1].copy()


def _parts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[int], list[int], bytes, list[int]]]:
    """(ids, offsets of the pieces in their texts, joined bytes, ends): the batch's texts in parts; long texts in several that overlap."""
    ids, offsets, joined, ends, size = [], [], [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        data = (text.as_py() or "").encode()
        for start in range(0, max(len(data) - length + 1, 0), PART):
            piece = data[start : start + PART + length - 1]
            if size and size + len(piece) > PART + length:
                yield ids, offsets, b"".join(joined), ends
                ids, offsets, joined, ends, size = [], [], [], [], 0
            ids.append(doc)
            offsets.append(start)
            joined.append(piece)
            size += len(piece)
            ends.append(size)
    if size:
        yield ids, offsets, b"".join(joined), ends


def _merged_runs(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of string starts joined where they touch in one document."""
    o = np.lexsort((first, doc))
    doc, first, last = doc[o], first[o], last[o]
    if not len(doc):
        return doc, first, last
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > last[:-1] + 1)  # in one document no run lies inside another
    at = np.nonzero(new)[0]
    return doc[at], first[at], np.maximum.reduceat(last, at)


#: What is shuffled for a block: its gram's hash, its digest, and where it is. at holds its first string, and in WIDE bits each
#: how far the last string and the gram are from it. A run of repeats has REPEAT in their place, a number to spread it by in h and the last string's distance in d1.
NAMES = ["h", "d1", "d2", "doc", "at"]
ROW = "h long, d1 long, d2 long, doc long, at long"
WIDE = 16
REPEAT = (1 << 2 * WIDE) - 1


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names=NAMES)


def _last_of_block(at: np.ndarray) -> np.ndarray:
    return (at >> 2 * WIDE) + (at >> WIDE & (1 << WIDE) - 1)


def _repeats(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    doc, first, last = _merged_runs(doc, first, last)
    spread = _mix(doc.view(np.uint64) + first.view(np.uint64)).view(np.int64)
    return _rows(spread, last - first, np.zeros(len(doc)), doc, first << 2 * WIDE | REPEAT)


def _frequent(length: int):
    """(id, text) -> (h, n): the grams with several blocks in a batch, and under a null all blocks of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [blocks_of(np.frombuffer(data, np.uint8), np.array(ends), length)[0] for _, _, data, ends in _parts(b, length)]
            if got:
                h, n = np.unique(np.concatenate(got), return_counts=True)
                many = n >= OFTEN
                yield pa.RecordBatch.from_arrays([pa.array([None, *h[many].tolist()], pa.int64()), pa.array([int(n.sum()), *n[many].tolist()], pa.int64())], names=["h", "n"])

    return run


def frequent_grams(rows: DataFrame, length: int) -> list[int]:
    """The grams of which rows(id, text) have so many blocks that they are spread over tasks; fewer than SHARE whatever the input.

    They only say how work is dealt out; results are the same without them.
    """
    counts = rows.mapInArrow(_frequent(length), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = counts.where(f"h is null or n >= {FREQUENT}").orderBy(F.desc("n")).limit(SHARE).collect()
    total = sum(r["n"] for r in counts if r["h"] is None)
    return [r["h"] for r in counts if r["h"] is not None and r["n"] > total // SHARE]


def _found(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of each batch. Blocks that an earlier one of the batch repeats as a whole are settled here."""
        for b in batches:
            got = [[] for _ in range(7)]
            for ids, offsets, data, ends in _parts(b, length):
                h, first, last, gram = blocks_of(np.frombuffer(data, np.uint8), np.array(ends), length)
                d1, d2 = digests(data, first, last + length, last - first << WIDE | gram - first)
                piece = np.searchsorted(np.array(ends), first, side="right")
                shift = (np.array(offsets) - np.array([0, *ends[:-1]]))[piece]
                for out, c in zip(got, (h, d1, d2, np.array(ids, np.int64)[piece], first + shift, last + shift, gram + shift)):
                    out.append(c)
            if not got[0]:
                continue
            h, d1, d2, doc, first, last, gram = map(np.concatenate, got)
            o = np.lexsort((first, doc, d2, d1, h))
            h, d1, d2, doc, first, last, gram = (c[o] for c in (h, d1, d2, doc, first, last, gram))
            head, _ = _heads(h, d1, d2)
            again = (doc != doc[head]) | (first != first[head])
            kept = np.nonzero(~again)[0]
            kept = kept[np.lexsort((first[kept], doc[kept]))]  # neighbours have much in common, which packs better
            at = first << 2 * WIDE | (last - first) << WIDE | (gram - first)
            yield _rows(*(c[kept] for c in (h, d1, d2, doc, at)))
            if again.any():
                yield _repeats(doc[again], first[again], last[again])

    return run


def _heads(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by keys: for each row the first with its keys, and which rows are such firsts."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.maximum.accumulate(np.where(new, np.arange(n), 0)), new


def _settled(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, d1, d2, doc, at): repeats of whole blocks, and the first blocks of each kind where a gram has several kinds, as frequent ones are taken to have."""
    pending: list | None = None  # the first row of the current block, until it is known whether its gram has another kind
    several = False
    for b in batches:
        cols = [b.column(i).to_numpy() for i in range(5)]
        settled = cols[4] & REPEAT == REPEAT
        if settled.any():
            yield _rows(*(c[settled] for c in cols))
            cols = [c[~settled] for c in cols]
        if not len(cols[0]):
            continue
        if pending is not None:  # the row held back stands before this batch
            cols = [np.append(np.array([p], np.int64), c) for p, c in zip(pending, cols)]
        h, d1, d2, doc, at = cols
        head, new = _heads(h, d1, d2)
        again = (doc != doc[head]) | (at != at[head])
        if again.any():
            yield _repeats(doc[again], at[again] >> 2 * WIDE, _last_of_block(at[again]))
        heads = np.nonzero(new)[0]
        same = h[heads[1:]] == h[heads[:-1]]
        many = np.append(False, same) | np.append(same, False)
        many[0] |= pending is not None and several
        many |= np.isin(h[heads], frequent)
        out = heads[:-1][many[:-1]]
        if len(out):
            yield _rows(*(c[out] for c in cols))
        pending, several = [c[heads[-1]] for c in cols], bool(many[-1])
    if pending is not None and several:
        yield _rows(*([p] for p in pending))


class Suffixes:
    """Suffixes of x that start at places and go on for sizes bytes, in groups of neighbouring rows."""

    def __init__(self, x: np.ndarray, places: np.ndarray, sizes: np.ndarray, groups: np.ndarray):
        self.x, self.places, self.sizes, self.groups = x, places, sizes, groups
        self.hashes = Prefixes(x)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes suffixes a and b begin alike, by binary search over the hashes of their prefixes."""
        p, q = self.places[a], self.places[b]
        high = np.minimum(self.sizes[a], self.sizes[b])
        low = np.zeros_like(high)
        while (low < high).any():
            mid = (low + high + 1) // 2
            alike = self.hashes.of(p, p + mid) == self.hashes.of(q, q + mid)
            low, high = np.where(alike, mid, low), np.where(alike, high, mid - 1)
        return low

    def _next(self, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The byte of suffix a after n bytes, -1 at its end."""
        inside = n < self.sizes[a]
        return np.where(inside, self.x[np.where(inside, self.places[a] + n, 0)].astype(np.int64), -1)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        return self._next(a, n) < self._next(b, n)

    def merged(self) -> np.ndarray:
        """The rows in the order of their suffixes within each group: a merge sort of all groups at once.

        Pairs of runs are merged by looking up how many of the other run come before each suffix.
        """
        n = len(self.places)
        start, _ = _heads(self.groups)
        size = np.bincount(start, minlength=n)[start] if n else start
        order, width = np.arange(n), 1
        while n and width < size.max():
            at = np.nonzero(size > width)[0]
            run = (at - start[at]) // width
            mine, end = start[at] + run * width, start[at] + size[at]
            other = np.where(run % 2 == 0, mine + width, mine - width)  # where the other run of the pair starts
            low, stop = np.zeros(len(at), np.int64), np.clip(end - other, 0, width)
            left = run % 2 == 0
            high = stop.copy()
            while True:
                open_ = np.nonzero(low < high)[0]
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                me, they = order[at[open_]], order[other[open_] + mid]
                # equal suffixes of a left run come before those of its right run
                before = np.where(left[open_], self.less(they, me), ~self.less(me, they))
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            to = np.where(left, at, at - width) + low
            new = order.copy()
            new[to] = order[at]
            order, width = new, 2 * width
        return order

    def checked(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, common): the sorted rows, and how many bytes each has in common with the one before, by their bytes."""
        order = self.merged()
        for _ in range(2):
            a, b = order[:-1], order[1:]
            n = self._alike(a, b)
            wrong = (self.groups[a] == self.groups[b]) & (self._next(a, n) > self._next(b, n))
            if not wrong.any():
                return order, np.append(0, n) if len(order) else n
            # hashes of different bytes were alike: these rows are sorted by their bytes
            data = self.x.tobytes()
            order = np.array(sorted(range(len(order)), key=lambda i: (self.groups[i], data[self.places[i] : self.places[i] + self.sizes[i]])), np.int64)
        raise AssertionError("bytes in order are out of order")

    def _alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.minimum(self.sizes[a], self.sizes[b])
        out = np.zeros(len(a), np.int64)
        for i in range(0, len(a), 1 << 13):
            p, q, m = self.places[a[i : i + (1 << 13)]], self.places[b[i : i + (1 << 13)]], most[i : i + (1 << 13)]
            step = np.arange(m.max(initial=0) + 1)
            inside = step < m[:, None]
            same = inside & (self.x[np.where(inside, p[:, None] + step, 0)] == self.x[np.where(inside, q[:, None] + step, 0)])
            out[i : i + (1 << 13)] = (~same).argmax(1)  # the last column is never inside
        return out


def shared_strings(groups: np.ndarray, doc: np.ndarray, first: np.ndarray, gram: np.ndarray, data: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(doc, first, last): runs of the strings in blocks that an earlier block of their group has at the same place beside the gram.

    Rows are in the order (group, doc, first + gram); gram is the gram's offset in data, the bytes of all strings of a block.
    """
    n, sizes = len(data), np.array([len(t) for t in data], np.int64)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    x = np.frombuffer(b"".join(data), np.uint8)
    starts = np.cumsum(sizes) - sizes
    after, after_common = Suffixes(x, starts + gram, sizes - gram, groups).checked()
    before, before_common = Suffixes(x[::-1], len(x) - starts - gram, gram, groups).checked()
    new_after, new_before = (np.append(True, groups[o][1:] != groups[o][:-1]) for o in (after, before))
    place = np.arange(GRAM - length, 1)
    gone = np.zeros((n, len(place) + 2), bool)  # with a column that is never set at either end
    in_after, in_before = np.empty(n, np.int64), np.empty(n, np.int64)
    for k, i in enumerate(place.tolist()):
        have = np.nonzero((gram + i >= 0) & (gram + i + length <= sizes))[0]
        if len(have) < 2:
            continue
        # strings that start i bytes from the gram are equal where both extensions are long enough
        in_after[after] = np.cumsum(new_after | (after_common < length + i))
        in_before[before] = np.cumsum(new_before | (before_common < -i))
        _, head, whose = np.unique(in_after[have] * (n + 1) + in_before[have], return_index=True, return_inverse=True)
        head = have[head][whose]
        gone[have, k + 1] = (doc[have] != doc[head]) | ((first + gram)[have] != (first + gram)[head])
    edge = np.diff(gone.astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    base = (first + gram)[row] + place[0]
    return doc[row], base + low, base + high - 1


def _sorted_groups(length: int):
    """(h, doc, first, gram, data) in the order of h -> (doc, first, last). The last group of a batch waits for the next one."""

    def search(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[0], r[1], r[2] + r[3], r[2], r[4]))
        h, doc, first, gram = (np.array(c, np.int64) for c in list(zip(*rows))[:4])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in shared_strings(h, doc, first, gram, [r[4] for r in rows], length)], names=["doc", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            held += zip(*(b.column(i).to_pylist() for i in range(5)))
            if len(held) < 4096:
                continue
            last = held[-1][0]
            ready = [r for r in held if r[0] != last]
            if ready:
                yield search(ready)
                held = [r for r in held if r[0] == last]
        if held:
            yield search(held)

    return run


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(id, text, asked) -> a row for each block asked for, with its bytes; a row like the one before is left out."""
    before = None
    for b in batches:
        h, doc, first, gram, data = [], [], [], [], []
        for d, text, asked in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            if not asked or (d, text) == before:
                continue
            before = d, text
            t = (text.as_py() or "").encode()
            for a in asked:
                h.append(a["h"])
                doc.append(d)
                first.append(a["first"])
                gram.append(a["gram"] - a["first"])
                data.append(t[a["first"] : a["last"] + length])
        yield _blocks(h, doc, first, gram, data, [GRAM] * len(h))


BLOCK_NAMES = ["h", "doc", "first", "gram", "data", "core"]
BLOCK = "h long, doc long, first long, gram int, data binary, core int"


def _blocks(h: list, doc: list, first: list, gram: list, data: list, core: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((h, doc, first, gram, data, core), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()))], names=BLOCK_NAMES)


def _halved(length: int):
    """Blocks whose strings share a core -> two blocks each, of the strings that start well before the core and of the others, with longer cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in BLOCK_NAMES]
            for h, doc, first, gram, data, core in zip(*(b.column(i).to_pylist() for i in range(6))):
                half = (length - core) // 2
                # strings that start low to high bytes before the core; their own core is what all of them have
                for low, high in ((length - core, half + 1), (half, 0)):
                    start, stop = max(gram - low, 0), min(gram - high, len(data) - length) + length
                    if stop - start < length:
                        continue
                    longer = data[gram - high : gram - low + length]
                    key = int.from_bytes(blake2b(longer + bytes([low - high & 255]), digest_size=8).digest(), "little", signed=True)
                    for o, x in zip(out, (key, doc, first + start, gram - high - start, data[start:stop], length - (low - high))):
                        o.append(x)
            yield _blocks(*out)

    return run


def _kept(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(id, text, runs, n_bytes, whole) -> a document's result; whole is the checksum of a text that loses nothing, if it is known."""
    for b in batches:
        out = [[], [], [], [], []]
        for d, text, runs, size, whole in zip(b.column(0).to_pylist(), b.column(1), *(b.column(i).to_pylist() for i in (2, 3, 4))):
            if not runs and whole is not None:
                result = (d, size, 0, 0, whole)
            else:
                t = (text.as_py() or "").encode()
                kept, at, spans = [], 0, 0
                for r in sorted((r["first"], r["last"]) for r in runs or ()):
                    if r[0] > at or not spans:
                        kept.append(t[at : r[0]])
                        spans += 1
                    at = max(at, r[1] + length)
                kept.append(t[at:])
                left = b"".join(kept)
                result = (d, len(t), len(t) - len(left), spans, sha256(left).hexdigest())
            for o, x in zip(out, result):
                o.append(x)
        yield pa.RecordBatch.from_arrays([*(pa.array(o, pa.int64()) for o in out[:4]), pa.array(out[4], pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_runs(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", most: int = SORTED) -> DataFrame:
    """(doc, first, last): runs of starts of strings of length bytes that also start earlier (smaller id, or same id and smaller start)."""
    if not GRAM < length < 1 << WIDE:
        raise ValueError(f"strings must be longer than {GRAM} bytes and shorter than {1 << WIDE}")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    frequent = frequent_grams(rows, length)
    held = np.array(frequent, np.int64)
    spread = F.when(F.col("h").isin(frequent), F.pmod("d1", F.lit(SPREAD))).otherwise(0) if frequent else F.lit(0)
    found = rows.mapInArrow(_found(length), ROW).repartition("h", spread)
    settled = checkpointed(found.sortWithinPartitions("h", "d1", "d2", "doc", "at").mapInArrow(lambda it: _settled(it, held), ROW))
    first = F.shiftright("at", 2 * WIDE)
    repeat = F.col("at").bitwiseAND(F.lit(REPEAT)) == REPEAT
    runs = settled.where(repeat).select("doc", first.alias("first"), (first + F.col("d1")).alias("last"))
    part = lambda by: first + F.shiftright("at", by).bitwiseAND(F.lit((1 << WIDE) - 1))
    differ = settled.where(~repeat).select("h", "doc", first.alias("first"), part(WIDE).alias("last"), part(0).alias("gram"))
    asked = differ.groupBy("doc").agg(F.collect_list(F.struct("h", "first", "last", "gram")).alias("asked"))
    blocks = may_have(rows, "id", differ.select("doc"), "_asked").where("_asked").join(asked, F.col("id") == F.col("doc")).select("id", "text", "asked").mapInArrow(lambda it: _cut(it, length), BLOCK)
    many, several = _crowded(differ, most)
    few = blocks
    while several:
        blocks = checkpointed(blocks)
        runs = runs.unionByName(_searched(blocks.join(many, "h", "left_anti"), length))
        crowded = blocks.join(many, "h", "left_semi").select(*BLOCK_NAMES)
        runs = runs.unionByName(_single(crowded.where(F.col("core") == length)))
        few = blocks = checkpointed(crowded.where(F.col("core") < length).mapInArrow(_halved(length), BLOCK))
        many, several = _crowded(blocks, most)
    return runs.unionByName(_searched(few, length))


def _crowded(blocks: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(h) of over most blocks, and how many they are; few are broadcast, so that their blocks are not brought together before they are halved."""
    many = checkpointed(blocks.groupBy("h").count().where(F.col("count") > most).select("h"))
    n = many.count()
    return (F.broadcast(many) if n <= 1 << 16 else many), n


def _searched(blocks: DataFrame, length: int) -> DataFrame:
    return blocks.select("h", "doc", "first", "gram", "data").repartition("h").sortWithinPartitions("h").mapInArrow(_sorted_groups(length), "doc long, first long, last long")


def _single(strings: DataFrame) -> DataFrame:
    """Of blocks of one string each, many of them equal: all but the first of each, by the SHA-256 of their bytes."""
    named = strings.select("doc", "first", F.sha2("data", 256).alias("w"))
    earliest = named.groupBy("w").agg(F.min(F.struct("doc", "first")).alias("e"))
    return named.join(earliest, "w").where(F.struct("doc", "first") > F.col("e")).select("doc", "first", F.col("first").alias("last"))


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", most: int = SORTED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row for each row of docs.

    Texts are UTF-8 bytes. Each byte goes that lies in a string of length bytes which also starts earlier,
    in a document with a smaller id or in the same one; strings are judged on the input and never cross
    documents. n_spans are the maximal removed runs, kept_sha256 is of the bytes left. Null and empty texts
    have no bytes; texts of any length are searched whole; rows that share an id are one document given
    several times: none of them repeats another, though their texts should be alike; rows with a null id
    have no place in the order and keep all bytes; other columns are ignored; an empty table gives an empty
    result. ids are whole numbers.
    """
    runs = checkpointed(repeated_runs(docs, length, id_col, text_col, most))
    by_doc = runs.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = may_have(rows, "id", runs.select("doc"), "_cut")  # the texts of the others stay where they are
    rows = rows.select("id", F.when(F.col("_cut"), F.col("text")).alias("text"), F.octet_length("text").cast("long").alias("n_bytes"), F.when(~F.col("_cut"), F.sha2("text", 256)).alias("whole"))
    joined = rows.join(by_doc, F.col("id") == F.col("doc"), "left").select("id", "text", "runs", "n_bytes", "whole")
    out = joined.mapInArrow(lambda it: _kept(it, length), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
