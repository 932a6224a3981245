"""One document of each group of near copies: SimHash fingerprints link what is very near, shingles what is alike enough.

Fingerprints of the shingles link texts as in the SimHash operator, through pigeonring filtering. At a similarity
of 0.8 two fingerprints differ in about 10 of 64 bits, too many for any filter to tell from chance; so texts
that no fingerprint links are searched further by bands of least hashes of the same shingles, and such a pair
is linked if its sets of shingles are alike at least the similarity asked for. A pair at similarity s shares a
band with probability 1 - (1 - s^ROWS)^BANDS: 0.9993 at 0.8. Each bucket's rows are searched together with
the bucket's smallest row, all pairs of them, so no pair of a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, keyed, one_of_each
from .components import connected_components, with_least
from .simhash import fingerprint_links, fingerprint_of, shingle_hashes

BANDS, ROWS = 24, 6
#: Bits in which two fingerprints may differ for a link without a further look at the shingles.
BITS = 4
#: Shingles that are hashed by all functions at once.
CHUNK = 1024
#: Rows of one search; a larger group is dealt out in blocks of half as many, which meet two by two.
BLOCK = 512

_DRAWN = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
TIMES, PLUS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted hashes of the different shingles of width words; a shorter text is one shingle, one without words has none."""
    return np.unique(shingle_hashes(text, width))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band; none without shingles."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.uint64((1 << 64) - 1))
    for i in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[i : i + CHUNK] * TIMES + PLUS).min(1), out=least)
    packed = least.astype("<u8").tobytes()
    keys = [xxhash.xxh64_intdigest(packed[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS)]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, fps, keys = [], [], []
            for t in b.column(1):
                all_hashes = shingle_hashes(t.as_py() or "", width)
                h = np.unique(all_hashes)
                own.append(xxhash.xxh128_digest(h.astype("<u8").tobytes()))
                fps.append(fingerprint_of(all_hashes))
                keys.append(bands(h))
            arrays = [b.column(0), pa.array(own, pa.binary()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "own", "fp", "bands"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):  # sets are as long as texts
                part = b.slice(i, 256)
                sets = [shingles(t.as_py() or "", width).astype("<u8").tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _linked(similarity: Fraction):
    """Of the rows of one search: links (a, b) that join all which chains of pairs as alike as similarity join.

    Rows with one label are joined already; pairs within one block of two are left to that block's own search.
    """
    num, den = similarity.numerator, similarity.denominator

    def run(group: pa.Table) -> pa.Table:
        node, label, block = (group[c].to_numpy() for c in ("node", "label", "block"))
        label = np.unique(label, return_inverse=True)[1]
        apart = block.min() != block.max()
        sets = [np.frombuffer(s.as_py(), "<u8") for s in group["shingles"]]
        sizes = np.array([len(s) for s in sets])
        flat, owner, place = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), np.arange(len(sets))
        out_a, out_b = [], []
        for i, s in enumerate(sets):
            asked = (place > i) & (label != label[i]) & (den * np.minimum(sizes, sizes[i]) >= num * np.maximum(sizes, sizes[i]))
            if apart:
                asked &= block != block[i]
            if not asked.any():
                continue
            inside = asked[owner]
            values, whose = flat[inside], owner[inside]
            found = s[np.minimum(np.searchsorted(s, values), len(s) - 1)] == values
            common = np.bincount(whose[found], minlength=len(sets))
            for j in np.flatnonzero(asked & (den * common >= num * (sizes + sizes[i] - common))).tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    out_a.append(node[i])
                    out_b.append(node[j])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def near_copies(rows: DataFrame, width: int, similarity: str, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """(key, component): one row for each row of rows(key long, text), key being different in each.

    Rows are linked whose fingerprints differ in at most bits bits, or whose sets of shingles are alike
    (common by all) at least similarity; component is the smallest key reachable. Texts without words are alike. Rows with one set are joined before any
    pair is looked for. rows must be checkpointed: keys are read more than once.
    """
    half = max(1, block // 2)
    prints = checkpointed(rows.select("key", "text").mapInArrow(_prints(width), "key long, own binary, fp long, bands array<long>"))
    nodes = prints.groupBy(F.col("own").alias("u")).agg(F.min("key").alias("m"), F.count(F.lit(1)).alias("n"))
    # a set that very many rows have is joined by broadcast
    kinds = checkpointed(with_least(prints.withColumnRenamed("own", "u"), nodes, prints.count()).withColumnsRenamed({"u": "own", "m": "node"}))
    keys = checkpointed(kinds.where("key = node").select("node", F.explode("bands").alias("band")))
    shared = keys.groupBy("band").agg(F.min("node").alias("rep"), F.max("node").alias("last")).where("rep < last").select("band", "rep")
    members = checkpointed(keys.join(shared, "band").where("rep < node").select("rep", "node").distinct())
    asked = members.select("node").unionByName(members.select(F.col("rep").alias("node"))).distinct()
    texts = rows.select(F.col("key").alias("node"), "text").join(asked, "node", "left_semi").select("node", "text")
    sets = checkpointed(texts.mapInArrow(_sets(width), "node long, shingles binary"))
    parts = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    own = members.join(parts, "rep").select("rep", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node")
    heads = parts.select("rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("rep").alias("node"))
    search = own.unionByName(heads).join(sets, "node").select("rep", "part", "node", F.col("node").alias("label"), F.lit(0).alias("block"), "shingles")
    links = checkpointed(search.groupBy("rep", "part").applyInArrow(_linked(Fraction(similarity)), "a long, b long"))
    large = parts.where("parts > 1")
    if large.take(1):  # what its parts left apart meets block by block
        found = connected_components(links)
        labels = members.join(large, "rep").join(found, "node", "left").select("rep", "node", F.coalesce("component", "node").alias("label"))
        open_ = labels.groupBy("rep").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.ceil(F.count(F.lit(1)) / half).cast("int").alias("blocks")).where("x < y")
        dealt = labels.join(open_, "rep").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.select("rep", "node", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("rep", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "node", "label", "block").join(sets, "node")
        more = dealt.groupBy("rep", "first", "second").applyInArrow(_linked(Fraction(similarity)), "a long, b long")
        links = links.unionByName(more)
    heads = kinds.where("key = node").groupBy("fp").agg(F.min("node").alias("least"))
    same = kinds.where("key = node").join(heads, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    near = fingerprint_links(checkpointed(heads.select("fp", F.col("least").alias("node"))), bits)
    found = connected_components(links.unionByName(same).unionByName(near)).withColumnRenamed("node", "_node")
    return kinds.join(found, F.col("node") == F.col("_node"), "left").select("key", F.coalesce("component", "node").alias("component"))


def one_of_near_copies(docs: DataFrame, width: int, similarity: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row of docs for each component of near_copies: that with the smallest id, nulls last. Repeated rows and rows of one id are told apart."""
    rows = keyed(docs, id_col, text_col)
    return one_of_each(rows, near_copies(rows.select("key", F.col(f"row.`{text_col}`").alias("text")), width, similarity, block))
