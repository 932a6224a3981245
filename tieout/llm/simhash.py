"""Near-duplicate documents by SimHash fingerprints, linked through pigeonring filtering.

With m = t + 1 segments in a ring, two fingerprints that differ in at most t bits have a segment from
which on each chain of l neighbouring segments differs in at most floor(l * t / m) = l - 1 bits. So the
first segment of that chain is equal in both and the next differs in one bit at most, which means that
one of its halves is equal too. These two parts and their places are the join key; the longer chains
prune what the key lets through, and only then all bits are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, keyed, one_of_each
from .components import connected_components

BITS = 64
#: Fingerprints under one key, or times the mean of all keys, beyond which pairs are not compared one by one.
HOT, HOT_TIMES = 128, 8
#: Fingerprints in one block of such a key, and blocks of one key at most that are looked at two by two.
BLOCK, MOST_BLOCKS = 8192, 64


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of width words, in order, repeats included; a shorter text is one shingle, one without words has none."""
    words = text.encode().lower().split()  # as bytes, so that A-Z and ASCII white space alone count
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=at[1:])
    starts, ends = at[: len(words) - width + 1].tolist(), (at[width:] - 1).tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends)], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if it is in over half the hashes; 0 without any."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        block = hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str, width: int) -> int:
    """The 64-bit fingerprint of the word shingles of text; 0 without words."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py() or "", width) for t in b.column(1)], pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _segments(bits: int) -> list[tuple[int, int]]:
    """(shift, width) of each of bits + 1 segments."""
    m = bits + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _part(fp: Column, shift: int, width: int) -> Column:
    if width == BITS:
        return fp
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _key_parts(bits: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """The two parts of a fingerprint in each kind of key: a segment, and half of the next (all of it where it has one bit)."""
    kinds, segments = [], _segments(bits)
    for i, (shift, width) in enumerate(segments):
        s, w = segments[(i + 1) % len(segments)]
        halves = [(s, w // 2), (s + w // 2, w - w // 2)] if bits > 0 else [(s, 0)]
        kinds += [((shift, width), half) for half in halves]
    return kinds


def _chains_hold(a: Column, b: Column, bits: int, kind: Column) -> Column:
    """Whether, from the kind's segment on, each chain of l segments differs in l - 1 bits at most."""
    segments, per = _segments(bits), 1 if bits == 0 else 2
    x, hold = a.bitwiseXOR(b), None
    for first in range(len(segments)):
        ring = segments[first:] + segments[:first]
        total, all_ok = F.lit(0), F.lit(True)
        for length, (shift, width) in enumerate(ring[:-1], 1):
            total = total + F.bit_count(_part(x, shift, width))
            if length > 1:
                all_ok = all_ok & (total <= length - 1)
        test = F.floor(kind / per) == first
        hold = F.when(test, all_ok) if hold is None else hold.when(test, all_ok)
    return hold.otherwise(F.lit(False))


def _stars(bits: int):
    """Of the fingerprints of one group: each with the smallest node of its component, (a, b) of them."""

    def run(group: pa.Table) -> pa.Table:
        fp, node = group["fp"].to_numpy().view(np.uint64), group["node"].to_numpy()
        left, rest = np.arange(len(fp)), fp  # places that are not reached yet, and their fingerprints
        out_a, out_b = [], []
        while len(left):
            one, todo, left, rest = [left[-1:]], [int(left[-1])], left[:-1], rest[:-1]
            while todo and len(left):
                near = np.bitwise_count(rest ^ fp[todo.pop()]) <= bits
                if near.any():
                    one.append(left[near])
                    todo += one[-1].tolist()
                    left, rest = left[~near], rest[~near]
            if len(one) > 1:
                nodes = np.sort(node[np.concatenate(one)])
                out_a.append(np.full(len(nodes) - 1, nodes[0]))
                out_b.append(nodes[1:])
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})

    return run


def _masks(kind: tuple[tuple[int, int], tuple[int, int]], most: int) -> list[int]:
    """All words of at most most bits outside the kind's parts."""
    free = [i for i in range(BITS) if not any(s <= i < s + w for s, w in kind)]
    return [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(free, n)]


def fingerprint_links(fps: DataFrame, bits: int, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fps(fp, node) at most bits apart.

    fps has each fingerprint once. Pairs under a key with at most hot fingerprints are compared in the
    join. A key with more is dealt out in blocks, and each two blocks give their components as stars, no
    more links than they have fingerprints. Where a key has more than MOST_BLOCKS blocks, or more than a
    fingerprint has points bits / 2 away from it outside the key's bits, each fingerprint is linked instead
    with the smallest node that shares such a point: two fingerprints share a point exactly if they are close
    enough. That is linear in the fingerprints of the key. All three ways give the same components.
    """
    kinds = _key_parts(bits)
    keys = F.array(*[F.lit(k << 40).cast("long").bitwiseOR(F.shiftleft(_part(F.col("fp"), *p), 20)).bitwiseOR(_part(F.col("fp"), *q)) for k, (p, q) in enumerate(kinds)]) if bits > 2 else None
    if keys is None:  # long segments: the parts don't fit beside each other, so their hash is the key
        keys = F.array(*[F.xxhash64(F.lit(k), _part(F.col("fp"), *p), _part(F.col("fp"), *q)) for k, (p, q) in enumerate(kinds)])
    rows = fps.where("node is not null").select("fp", "node", F.posexplode(keys).alias("kind", "key"))
    possible = len(kinds) * 2.0 ** min(p[1] + q[1] for p, q in kinds)
    hot = max(hot, int(HOT_TIMES * fps.count() * len(kinds) / possible))
    full = checkpointed(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot))
    short, long = bits // 2, bits - bits // 2  # of an odd number one of the two goes one bit further
    free = min(BITS - p[1] - q[1] for p, q in kinds)
    most = block * min(MOST_BLOCKS, sum(comb(free, n) for n in range(long + 1)))
    largest = full.agg(F.max("n")).first()[0] or 0
    usual = rows.join(full, "key", "left_anti") if largest else rows
    a, b = usual.alias("a"), usual.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & _chains_hold(F.col("a.fp"), F.col("b.fp"), bits, F.col("a.kind")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits)
    links = a.join(b, near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    if largest and block:
        blocks = full.where(F.col("n") <= most).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
        dealt = rows.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        # a row meets each block once: with its own block as the first of the pair or as the second
        dealt = dealt.select("key", "fp", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "fp", "node")
        links = links.unionByName(dealt.groupBy("key", "first", "second").applyInArrow(_stars(bits), "a long, b long"))
    if largest > most:
        many = rows.join(full.where(F.col("n") > most), "key", "left_semi")
        for k, kind in enumerate(kinds):
            signed = [m - (1 << 64) if m >> 63 else m for m in _masks(kind, long)]
            table = F.split(F.lit(",".join(map(str, signed))), ",").cast("array<bigint>")
            points = many.where(F.col("kind") == k).select("node", "fp", F.explode(table).alias("mask")).select("node", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"), F.bit_count("mask").alias("away"))
            least = points.where(F.col("away") <= short).groupBy("point").agg(F.min("node").alias("least"))
            met = points.join(least, "point").where("node <> least")
            links = links.unionByName(met.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return links.distinct()


def simhash_groups(docs: DataFrame, width: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs.

    Texts are lower-cased in A-Z and split at ASCII white space; a bit of the fingerprint is 1 if it is
    in over half the XXH64 hashes (seed 42) of the shingles of width words. Documents whose fingerprints
    differ in at most bits bits are linked; component_id is the smallest id reachable. Null, empty and
    blank texts have fingerprint 0, linked like any other; texts of any length are read whole; equal
    fingerprints are joined before any pair is looked for; rows with a null id get the component of
    their fingerprint (null if no row with that fingerprint has an id); other columns are ignored; an
    empty table gives an empty result. ids are whole numbers.
    """
    prints = checkpointed(fingerprints(docs, width, id_col, text_col))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("node"))
    found = connected_components(fingerprint_links(nodes, bits, hot)).withColumnRenamed("node", "_node")
    groups = nodes.join(found, F.col("node") == F.col("_node"), "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(groups, "fp").select(F.col("id").alias(id_col), text.alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, width: int, bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: that with the smallest id, nulls last. Repeated rows and rows of one id are told apart."""
    rows = keyed(docs, id_col, text_col)
    groups = simhash_groups(rows.select("key", F.col(f"row.`{text_col}`").alias("text")), width, bits, "key", "text")
    return one_of_each(rows, groups.select("key", F.col("component_id").alias("component")))
