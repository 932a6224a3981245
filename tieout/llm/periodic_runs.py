"""Periodic runs of words, by branching tandem repeats in suffix trees.

A tandem repeat is a stretch that is some words twice over; it branches if the word after it differs
from the one half of it earlier. In the suffix tree of a text, a branching tandem repeat with halves of d
words at place i is a pair of leaves i and i + d that part at a node of depth d. So for each node the
leaves of its smaller side are gone through, and the leaf d further and the leaf d back are looked up on
the other side: with the smaller side always, a leaf is visited log n times at most. Each branching
repeat is then rotated to the left as far as its period holds, which gives a run whose right end it is.

Trees are held as sorted suffixes with the depth at which neighbours part; a node with many children is a
chain of nodes of one depth with two. They are made only for stretches of a text whose windows of words
all come again within the stretch: a run with four periods or more never leaves such a stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Passes at most in which stretches are made shorter.
PASSES = 6
#: Bytes of text whose trees are built together (a longer text goes alone), and leaves looked up at once.
STEP_BYTES, STEP_LEAVES = 2 << 20, 1 << 20

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def window_of(words: int, periods: int) -> int:
    """Words of the windows that all come again inside a run: short enough that each has its like a period before or after it."""
    return max(1, min(max(words, periods * q) - 2 * q + 1 for q in range(1, words + 1)))


def repeating(codes: np.ndarray, part: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, stretch of each): the places of windows that come twice or more in their stretch; a stretch lies in one part.

    Windows are told by a hash: one taken for another by chance makes a stretch longer and changes no run, and
    neither does a stretch that more passes would make shorter.
    """
    places, stretch = np.arange(len(codes)), part
    for _ in range(PASSES):
        if not len(places):
            break
        n, here = len(places), codes[places].astype(np.uint64)
        h = stretch.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(window):
            h[: n - k] = (h[: n - k] ^ here[k:]) * np.uint64(0xD6E8FEB86659FD93)
            h[: n - k] ^= h[: n - k] >> np.uint64(32)
        whole = np.zeros(n, bool)  # windows that end within their stretch
        whole[: max(n - window + 1, 0)] = stretch[: max(n - window + 1, 0)] == stretch[window - 1 :]
        at = np.nonzero(whole)[0]
        by = at[np.argsort(h[at], kind="stable")]
        same = h[by][1:] == h[by][:-1]
        twice = np.zeros(len(by), bool)
        twice[1:] |= same
        twice[:-1] |= same
        first = by[twice]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + window, -1)
        covered = np.cumsum(edge[:n]) > 0
        kept, old = places[covered], stretch[covered]
        new = np.concatenate([[0], np.cumsum((np.diff(kept) != 1) | (np.diff(old) != 0))]) if len(kept) else old
        if len(kept) == n and new[-1] == len(np.unique(stretch)) - 1:
            return kept, new
        places, stretch = kept, new
    return places, stretch


def sorted_suffixes(codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes of all stretches, each of which ends at end[place]; no code is in two stretches."""
    n, step = len(codes), 1
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    at = np.arange(n)
    while True:
        inside = at + step < end
        key = rank * (n + 1)
        key[inside] += rank[at[inside] + step] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if rank[order[-1]] == n - 1:
            return order, rank
        step *= 2


def parting(codes: np.ndarray, order: np.ndarray, rank: np.ndarray) -> list[int]:
    """For each suffix but the first in order, how many codes it has in common with the one before it; -1 stands first."""
    text, before, depth, d = [*codes.tolist(), -1], order.tolist(), [-1] * len(order), 0
    for i, r in enumerate(rank.tolist()):
        if r:
            j = before[r - 1]
            last = max(i, j)
            while last + d < len(order) and text[i + d] == text[j + d]:
                d += 1
            depth[r] = d
            d = max(d - 1, 0)
        else:
            d = 0
    return depth


def nodes_of(depth: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): the node that parts suffixes k - 1 and k has the suffixes left[k] to right[k], the last excluded."""
    n = len(depth)
    left, right, stack = [0] * n, [n] * n, [0]
    for k in range(1, n):
        d = depth[k]
        while depth[stack[-1]] > d:
            right[stack.pop()] = k
        left[k] = stack[-1]
        stack.append(k)
    return np.array(left), np.array(right)


def branching_repeats(order: np.ndarray, rank: np.ndarray, depth: np.ndarray, left: np.ndarray, right: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, words of a half) of the branching tandem repeats at the given nodes."""
    n = len(order)
    near = nodes - left[nodes] <= right[nodes] - nodes
    from_, to = np.where(near, left[nodes], nodes), np.where(near, nodes, right[nodes])
    other, end = np.where(near, nodes, left[nodes]), np.where(near, right[nodes], nodes)
    ends = np.cumsum(to - from_)
    at = 0
    while at < len(nodes):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_LEAVES, "right")))
        size = (to - from_)[at:upto]
        node = np.repeat(np.arange(at, upto), size)
        leaf = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + from_[node]
        place, d = order[leaf], depth[nodes[node]]
        for first, second in ((place, place + d), (place - d, place - d)):
            asked = np.nonzero((second < n) & (second >= 0))[0]
            where = rank[second[asked]]
            asked = asked[(where >= other[node[asked]]) & (where < end[node[asked]])]
            yield first[asked], d[asked]
        at = upto


def run_start(codes: np.ndarray, place: int, period: int, least: int) -> int:
    """The first place, not before least, from which on the period holds up to place."""
    size = 64
    while place > least:
        from_ = max(place - size, least)
        differ = np.nonzero(codes[from_:place] != codes[from_ + period : place + period])[0]
        if len(differ):
            return from_ + int(differ[-1]) + 1
        place, size = from_, size * 2
    return place


def runs_of(codes: np.ndarray, part: np.ndarray, words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of codes, none of which leaves its part, with so many words and periods at least."""
    places, stretch = repeating(codes, part, window_of(words, periods))
    if not len(places):
        return []
    n = len(places)
    starts = np.concatenate([[0], np.nonzero(np.diff(stretch))[0] + 1])
    end = np.concatenate([starts[1:], [n]])[stretch]
    begin = starts[stretch]
    text = np.unique(stretch * (int(codes.max()) + 1) + codes[places], return_inverse=True)[1].astype(np.int64)
    order, rank = sorted_suffixes(text, end)
    depths = parting(text, order, rank)
    left, right = nodes_of(depths)
    depth = np.array(depths)
    nodes = np.nonzero((depth > 0) & (depth * periods <= (end - begin)[order]))[0]
    found = []
    for place, d in branching_repeats(order, rank, depth, left, right, nodes):
        first = place + 2 * d - np.maximum(periods * d, words)  # a run that ends here and is long enough begins there or before
        fine = first >= begin[place]
        place, d, first = place[fine], d[fine], first[fine]
        fine = text[first] == text[first + d]
        found.append(np.stack([place[fine] + 2 * d[fine], d[fine]]))
    ends, halves = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    runs = []
    cuts = [*(np.nonzero(np.diff(ends))[0] + 1).tolist(), len(ends)] if len(ends) else []
    at = 0
    for cut in cuts:  # repeats with one right end: the shortest has the smallest period of its run, and its multiples are the same run
        stop, left_over = int(ends[at]), halves[at:cut]
        while len(left_over):
            d = int(left_over[0])
            start = run_start(text, stop - 2 * d, d, int(begin[stop - 1]))
            if stop - start >= max(words, periods * d):
                runs.append((int(places[start]), int(places[stop - 1]) + 1, d))
            left_over = left_over[1:]
            left_over = left_over[(left_over % d != 0) | (2 * left_over > stop - start)]
        at = cut
    return runs


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of slices of batch with about STEP_BYTES each."""
    first, held, texts = 0, 0, []
    for i, t in enumerate(batch.column(1)):
        texts.append(t.as_py() or b"")
        held += len(texts[-1])
        if held >= STEP_BYTES:
            yield first, texts
            first, held, texts = i + 1, 0, []
    if texts:
        yield first, texts


def _searched(words: int, periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _texts(batch):
                split = [t.split() for t in texts]
                sizes = np.array([len(w) for w in split])
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                known: dict[bytes, int] = {}
                codes = np.array([known.setdefault(w, len(known)) for ws in split for w in ws], np.int64)
                runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for start, end, period in runs_of(codes, np.repeat(np.arange(len(texts)), sizes), words, periods):
                    k = int(np.searchsorted(offsets, start, "right")) - 1
                    runs[k].append((start - int(offsets[k]), end - start, period))
                collapsed = []
                for ws, rs in zip(split, runs):
                    rs.sort(key=lambda r: (r[0], r[2]))
                    if rs:
                        kept = np.ones(len(ws), bool)
                        for start, length, period in rs:
                            kept[start + period : start + length] = False
                        ws = [ws[i] for i in np.nonzero(kept)[0].tolist()]
                    collapsed.append(b" ".join(ws))
                structs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], pa.list_(RUN))
                ids = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), structs, pa.array(collapsed, pa.binary())], names=["id", "n", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): one row for each row of docs, no shuffle.

    Words are numbered from 0. A run is a stretch of consecutive words in which words a smallest period
    apart are alike, with at least so many words and periods, that no neighbouring word extends; runs is
    an array of (start, length, period) by start, then period. collapsed has the words, joined by one
    space, without those that any run contains after its first period. A null or empty text has no words
    and no runs, its collapsed text is empty; a text of any length is searched whole, in memory that grows
    with its words; repeated rows and null ids each keep their row; other columns are ignored; an empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    run = "array<struct<start:long,length:long,period:long>>"
    found = rows.mapInArrow(_searched(words, periods), f"id {kind}, n long, runs {run}, collapsed binary")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text of about one id in ten made periodic, by numbers from the CRC-32 of its id; a null id counts as an empty name."""
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        from_, period = g % n, 1 + F.floor((n - g % n) / (3 + g % 8))
        place = let(F.struct(from_.alias("a"), period.alias("p")), lambda s: F.transform(words, lambda w, i: F.get(words, F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int"))))
        return F.when(n > 0, F.array_join(place, " ")).otherwise(F.lit(""))

    text = F.when(h % 10 == 0, let(F.regexp_extract_all(F.col(text_col), F.lit(WORD), 0), planted)).otherwise(F.col(text_col))
    return docs.select(F.col(id_col), text.alias(text_col))


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of periodic_runs: the number of runs, the greatest one (ties: smallest start, then period; nulls without runs), and SHA-256s of all runs and of the collapsed text."""
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    df = found.withColumn("_most", F.array_min(order))
    return df.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("_most.s").alias("start"), (-F.col("_most.l")).alias("length"), F.col("_most.p").alias("period"),
        F.floor(1000 * (-F.col("_most.l")) / F.col("_most.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
