"""Near-duplicate vectors: sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import connected_components

#: Mean vectors of a label under one hash, and vectors compared in one task step at most.
BUCKET, BLOCK = 48, 1024
#: Bytes of one code.
CODE = 4
#: Share of the pairs at the least cosine that no table may bring together.
MISS = 1e-4


def tables_for(largest_label: int, cosine: float) -> tuple[int, int]:
    """(bits of a hash, tables): a bit is alike with probability 1 - angle / pi, and the tables bring all but MISS of the pairs together."""
    bits = max(3, math.ceil(math.log2(max(largest_label, 1) / BUCKET)))
    alike = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - alike)))


@cache
def _planes(size: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(20_240_117).standard_normal((tables * bits, size))


def _codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The codes of one vector in all tables; always worked out in this way, so that they are the same in every task."""
    return ((_planes(len(x), bits, tables) @ x) > 0).reshape(tables, bits) @ (1 << np.arange(bits))


def _hashed(bits: int, tables: int):
    """(id, n, label, v) -> the same with codes: the codes of v in all tables, CODE bytes each."""

    def run(batches):
        for b in batches:
            codes = [_codes(np.array(v.as_py(), float), bits, tables).astype(">u4").tobytes() for v in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary())], names=["id", "n", "label", "v", "codes"])

    return run


def _spanning(near: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges (a, b) that join what the symmetric matrix near joins: each id with the smallest of its part."""
    left, out_a, out_b = np.ones(len(ids), bool), [], []
    for at in np.argsort(ids, kind="stable").tolist():
        if not left[at]:
            continue
        left[at] = False
        todo, mine = [at], []
        while todo:
            new = np.nonzero(near[todo].any(0) & left)[0]
            left[new] = False
            todo = new.tolist()
            mine += todo
        out_a += [int(ids[at])] * len(mine)
        out_b += ids[mine].tolist()
    return out_a, out_b


def _compared(cosine: float, bits: int, tables: int):
    """Of one bucket, or of two blocks of a large one: links of each vector that no earlier table has, and edges that span the linked.

    Which pairs earlier tables bring together follows from the codes of the linked vectors, worked out here.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        table, first, second = (key[i].as_py() for i in (2, 3, 4))
        ids, block, times = (group[c].to_numpy() for c in ("id", "block", "times"))
        sizes = np.array([len(v) for v in group["v"]])
        out_id, out_n, edge_a, edge_b = [], [], [], []
        for size in np.unique(sizes):
            at = np.nonzero(sizes == size)[0]
            raw = np.array([group["v"][int(i)].as_py() for i in at], float)
            x = raw / np.sqrt((raw * raw).sum(1, keepdims=True))
            left = np.nonzero(block[at] == first)[0]
            right = np.nonzero(block[at] == second)[0]
            near = np.zeros((len(at), len(at)), bool)
            near[np.ix_(left, right)] = x[left] @ x[right].T >= cosine
            near |= near.T
            np.fill_diagonal(near, False)
            linked = np.nonzero(near.any(0))[0]
            if table and len(linked):
                inner = near[np.ix_(linked, linked)]
                for codes in np.array([_codes(raw[i], bits, tables)[:table] for i in linked]).T:  # pairs that an earlier table brought together are counted there
                    inner &= codes[:, None] != codes[None, :]
                near[np.ix_(linked, linked)] = inner
            n = near @ times[at]
            some = np.nonzero(n)[0]
            out_id += ids[at][some].tolist()
            out_n += n[some].tolist()
            a, b = _spanning(near, ids[at])
            edge_a += a
            edge_b += b
        none = lambda n: pa.nulls(n, pa.int64())
        rows, edges = none(len(out_id)), none(len(edge_a))
        return pa.table({
            "id": pa.concat_arrays([pa.array(out_id, pa.int64()), edges]), "n": pa.concat_arrays([pa.array(out_n, pa.int64()), edges]),
            "a": pa.concat_arrays([rows, pa.array(edge_a, pa.int64())]), "b": pa.concat_arrays([rows, pa.array(edge_b, pa.int64())]),
        })

    return run


def embedding_links(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of vectors.

    Vectors of one label and length are linked if their cosine in double precision is at least cosine.
    Equal vectors of a label are one point, with as many links among themselves as they are; only points
    are searched. Pairs are those that random hyperplanes hash alike in one of several tables; bits and
    tables follow the largest label, so that a pair at the least cosine is missed with probability MISS
    (nearer pairs far less often). n_links counts the other ids linked directly, each pair in the first
    table that has it; component_id is the smallest id reachable. A bucket of more than block points is
    compared in pairs of blocks, so no task holds more than two blocks; what leaves it are counts and
    spanning edges. Null labels, null, empty and zero vectors and those with a null or non-finite component
    link with nothing; an id that comes twice counts once, with its smallest label and vector, and each of
    its rows gets the result; rows with a null id have no links and no component; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fine = F.forall("v", number) & F.exists("v", lambda x: x != 0)
    usable = rows.where("id is not null and label is not null and v is not null").where(fine)
    usable = usable.groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.label", "s.v")
    points = checkpointed(usable.groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    largest = points.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, cosine)
    kinds = {c: points.schema[c].dataType.simpleString() for c in ("label", "v")}
    hashed = points.select("id", "n", "label", "v").mapInArrow(_hashed(bits, tables), f"id long, n long, label {kinds['label']}, v {kinds['v']}, codes binary")
    # a row goes to each table with its code there
    t = F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))
    code = F.expr(f"substring(codes, t * {CODE} + 1, {CODE})")
    sizes = hashed.select("label", "codes", t.alias("t")).select("label", "t", code.alias("code")).groupBy("label", "t", "code").count().where(F.col("count") > 1)
    sizes = sizes.select(F.col("label").alias("l"), F.col("t").alias("u"), F.col("code").alias("c"), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    spread = hashed.select("id", F.col("n").alias("times"), "label", "v", "codes", t.alias("t")).withColumn("code", code).drop("codes")
    dealt = spread.join(sizes, (F.col("label") == F.col("l")) & (F.col("t") == F.col("u")) & (F.col("code") == F.col("c")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a row meets each block once: with its own block as the first of the pair or as the second
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("id", "times", "label", "v", "t", "code", "block", other.alias("other")).withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    found = dealt.groupBy("label", "code", "t", "first", "second").applyInArrow(_compared(cosine, bits, tables), "id long, n long, a long, b long")
    found = checkpointed(found)
    counts = found.where("id is not null").groupBy("id").agg(F.sum("n").alias("n_links"))
    parts = connected_components(found.where("a is not null").select("a", "b")).withColumnRenamed("node", "id")
    of_points = points.select("id", "n").join(counts, "id", "left").join(parts, "id", "left")
    of_points = of_points.select(F.col("id").alias("point"), (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    several = points.where("n > 1").select(F.col("label").alias("l"), F.col("v").alias("w"), F.col("id").alias("point"))
    copies = usable.join(several, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).where("id <> point").select("id", "point")
    result = of_points.select(F.col("point").alias("id"), "n_links", "component_id").unionByName(copies.join(of_points, "point").drop("point"))
    out = rows.select("id").join(result, "id", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
