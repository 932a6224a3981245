"""Nearest vectors by inner product: vantage-point trees per shard.

Inner products become distances by one more component: with a vector v goes sqrt(M^2 - |v|^2), M being the
largest norm, and with a query goes 0; then |q - v|^2 = |q|^2 + M^2 - 2 q.v, so the nearest vector has the
largest inner product and the triangle inequality holds. A shard is what lies nearest to one of some
vantage points of the whole table; in a shard a tree of vantage points is built. Both levels leave out what
the triangle inequality, relaxed by a factor, says is farther than the k-th nearest found so far.

Equal vectors are one point, whatever their number, and every scored pair is multiplied and summed in the
order of the components in double precision, so that scores are the same wherever they are worked out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Points of a shard and queries of a block (shards and blocks beyond are split), and vantage points of the table at most.
SHARD, BLOCK, VANTAGES = 4096, 4096, 2048
#: Points of a leaf, and points tried as a vantage point and those that they are tried on.
LEAF, TRIED, TRIED_ON = 64, 6, 64
#: Lengths of vectors in a table at most; vectors of different lengths never meet.
LENGTHS = 64
#: Queries that share a vector beyond which share of all queries get their result by a broadcast: fewer than HOT vectors, so.
HOT = 1000
#: The relaxation of pruning by default: recall was 0.998 at least on vectors in groups and on others (the README has the figures).
FACTOR = 1.2
#: Part of the largest norm that rounding may move a distance by.
SLACK = 1e-6


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and v, summed from the first component to the last."""
    total = np.zeros(len(q))
    for k in range(q.shape[1]):
        total += q[:, k] * v[:, k]
    return total


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that brings all to one norm."""
    return np.concatenate([x, np.sqrt(np.maximum(most * most - (x * x).sum(1, keepdims=True), 0.0))], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0.0))


class VantageTree:
    """A tree over the rows of x, lifted to most; search gives the k best rows of each query."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, most: float):
        self.x, self.ids, self.most = x, ids, most
        self.up = lifted(x, most)
        self.rng = np.random.default_rng(len(x))
        #: (vantage point, near child, far child, least and greatest distance of each) or the rows of a leaf.
        self.nodes: list[tuple | np.ndarray] = []
        self.root = self._node(np.arange(len(x)))

    def _node(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(rows)
        if len(rows) > LEAF:
            tried = self.rng.choice(rows, min(TRIED, len(rows)), replace=False)
            on = self.rng.choice(rows, min(TRIED_ON, len(rows)), replace=False)
            point = int(tried[np.argmax(distances(self.up[tried], self.up[on]).std(1))])
            d = distances(self.up[point][None], self.up[rows])[0]
            by = np.argsort(d, kind="stable")
            half = len(rows) // 2
            near, far = by[:half], by[half:]
            left, right = self._node(rows[near]), self._node(rows[far])
            self.nodes[at] = (point, left, right, d[near[0]], d[near[-1]], d[far[0]], d[far[-1]])
        return at

    def search(self, q: np.ndarray, k: int, least: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, float]:
        """(rows, scores, share of pairs scored): the k rows of each query with the largest inner products, ties to smaller ids, -1 where there are fewer.

        Rows with less than least count as farther than k others; a part goes unseen where factor times
        its least possible distance is over the distance of the k-th best: factor 1 loses nothing.
        """
        up = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        norm = (q * q).sum(1)
        slack = SLACK * (np.sqrt(norm) + self.most)
        best_score, best_row = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        floor = least.astype(float).copy()
        seen = 0

        def reach(who: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(norm[who] + self.most**2 - 2 * floor[who], 0.0)) + slack[who]

        def descend(at: int, who: np.ndarray) -> None:
            """A first bound of each query from the leaf where it belongs."""
            node = self.nodes[at]
            if isinstance(node, np.ndarray):
                if len(node) >= k:
                    s = q[who] @ self.x[node].T
                    floor[who] = np.maximum(floor[who], np.partition(s, -k, axis=1)[:, -k] - SLACK * self.most * np.sqrt(norm[who]))
                return
            point, near, far, _, near_to, far_from, _ = node
            inner = distances(up[who], self.up[point][None])[:, 0] * 2 < near_to + far_from
            for child, side in ((near, inner), (far, ~inner)):
                if side.any():
                    descend(child, who[side])

        def visit(at: int, who: np.ndarray) -> None:
            nonlocal seen
            node = self.nodes[at]
            if isinstance(node, np.ndarray):
                seen += len(who) * len(node)
                rough = q[who] @ self.x[node].T
                a, b = np.nonzero(rough >= (floor[who] - SLACK * self.most * np.sqrt(norm[who]))[:, None])
                exact = products(q[who[a]], self.x[node[b]])
                fine = exact >= floor[who[a]]
                a, b, exact = a[fine], b[fine], exact[fine]
                scores, rows = np.full(rough.shape, -np.inf), np.full(rough.shape, -1)
                scores[a, b], rows[a, b] = exact, node[b]
                some = np.unique(a)
                who, scores, rows = who[some], np.concatenate([best_score[who[some]], scores[some]], 1), np.concatenate([best_row[who[some]], rows[some]], 1)
                order = np.argsort(np.where(rows >= 0, self.ids[rows], np.iinfo(np.int64).max), axis=1, kind="stable")
                order = np.take_along_axis(order, np.argsort(-np.take_along_axis(scores, order, 1), axis=1, kind="stable"), 1)[:, :k]
                best_score[who], best_row[who] = np.take_along_axis(scores, order, 1), np.take_along_axis(rows, order, 1)
                floor[who] = np.maximum(floor[who], best_score[who, -1])
                return
            point, near, far, *bounds = node
            d = distances(up[who], self.up[point][None])[:, 0]
            sides = [(near, np.maximum(bounds[0] - d, d - bounds[1])), (far, np.maximum(bounds[2] - d, d - bounds[3]))]
            for child, away in sides if (sides[0][1] < sides[1][1]).mean() >= 0.5 else sides[::-1]:
                side = factor * away <= reach(who)
                if side.any():
                    visit(child, who[side])

        if len(q) and len(self.x):
            descend(self.root, np.arange(len(q)))
            visit(self.root, np.arange(len(q)))
        return best_row, best_score, seen / max(1, len(q) * len(self.x))


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def _placed(vantages: np.ndarray, most: float):
    """(point, v, queries) -> the same with the nearest vantage point and the distance to it."""
    up = lifted(vantages, most)

    def run(batches):
        for b in batches:
            d = distances(lifted(_matrix(b.column(1), vantages.shape[1]), most), up)
            at = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array(d[np.arange(len(at)), at])], names=["point", "v", "queries", "shard", "far"])

    return run


def _bounded(size: int, most: float, k: int, factor: float):
    """One part of a shard -> (point, least) of the queries in it: the inner product that k of its points reach."""

    def run(group: pa.Table) -> pa.Table:
        x, ids = _matrix(group["v"], size), group["point"].to_numpy()
        asks = np.nonzero(group["queries"].to_numpy() > 0)[0]
        least = np.full(len(asks), -np.inf)
        if len(asks):
            tree = VantageTree(x, ids, most)
            for at in range(0, len(asks), BLOCK):
                _, scores, _ = tree.search(x[asks[at : at + BLOCK]], k, least[at : at + BLOCK], factor)
                least[at : at + BLOCK] = scores[:, -1]
        return pa.table({"point": pa.array(ids[asks], pa.int64()), "least": pa.array(least, pa.float64())})

    return run


def _asked(vantages: np.ndarray, radii: np.ndarray, most: float, factor: float):
    """(point, v, least) -> (point, v, least, shard) for each shard that may hold something nearer; radii: least and greatest distance of each shard's points."""
    up = lifted(vantages, most)

    def run(batches):
        for b in batches:
            q = _matrix(b.column(1), vantages.shape[1])
            norm = (q * q).sum(1)
            d = distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), up)
            reach = np.sqrt(np.maximum(norm + most**2 - 2 * b.column(2).to_numpy(), 0.0)) + SLACK * (np.sqrt(norm) + most)
            row, shard = np.nonzero(factor * np.maximum(radii[:, 0] - d, d - radii[:, 1]) <= reach[:, None])
            yield from pa.Table.from_batches([b]).take(pa.array(row)).append_column("shard", pa.array(shard, pa.int32())).to_batches()

    return run


def _searched(size: int, most: float, k: int, factor: float):
    """One part of a shard and one block of queries -> (point, near, score): the k nearest of the part's points for each query."""

    def run(points: pa.Table, asks: pa.Table) -> pa.Table:
        ids, who = points["point"].to_numpy(), asks["point"].to_numpy()
        out = [[], [], []]
        if len(ids) and len(who):
            tree = VantageTree(_matrix(points["v"], size), ids, most)
            q, least = _matrix(asks["v"], size), asks["least"].to_numpy()
            for at in range(0, len(who), BLOCK):
                rows, scores, _ = tree.search(q[at : at + BLOCK], k, least[at : at + BLOCK], factor)
                a, b = np.nonzero(rows >= 0)
                for column, values in zip(out, (who[at + a], ids[rows[a, b]], scores[a, b])):
                    column.append(values)
        joined = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"point": pa.array(joined[0], pa.int64()), "near": pa.array(joined[1], pa.int64()), "score": pa.array(joined[2], pa.float64())})

    return run


def _parts(count: Column, most: int) -> Column:
    return F.greatest(F.ceil(count / most), F.lit(1)).cast("int")


def _of_one_length(points: DataFrame, size: int, k: int, factor: float, shard: int) -> DataFrame:
    """(point, near, score): for each point that queries ask for, the k nearest points and more."""
    kind = points.schema["v"].dataType.simpleString()
    stats = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm")).first()
    most = float(np.sqrt(stats["norm"])) * (1 + 1e-12)
    wanted = min(VANTAGES, -(-stats["n"] // shard))
    vantages = np.array([r.v for r in points.orderBy(F.xxhash64("point"), "point").select("v").limit(wanted).collect()], float)
    placed = checkpointed(points.select("point", "v", "queries").mapInArrow(_placed(vantages, most), f"point long, v {kind}, queries long, shard int, far double"))
    shards = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("from"), F.max("far").alias("to"))  # as many rows as vantage points
    radii = np.full((len(vantages), 2), np.inf)  # a shard without points is never asked
    for r in shards.collect():
        radii[r.shard] = r["from"], r["to"]
    dealt = placed.join(F.broadcast(shards.select("shard", _parts(F.col("n"), shard).alias("parts"))), "shard")
    dealt = dealt.select("shard", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int").alias("part"), "parts", "point", "v", "queries")
    bound = _bounded(size, most, k, factor)
    least = dealt.groupBy("shard", "part").applyInArrow(lambda t: bound(t), "point long, least double")
    asking = placed.where("queries > 0").select("point", "v").join(least, "point")
    asked = checkpointed(asking.select("point", "v", "least").mapInArrow(_asked(vantages, radii, most, factor), f"point long, v {kind}, least double, shard int"))
    visits = shards.join(asked.groupBy("shard").agg(F.count(F.lit(1)).alias("asks")), "shard").select("shard", _parts(F.col("n"), shard).alias("all"), _parts(F.col("asks"), BLOCK).alias("blocks"))
    visits = F.broadcast(visits)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.select("shard", "part", "point", "v").join(visits, "shard").select("shard", "part", numbers("blocks").alias("block"), "point", "v")
    right = asked.join(visits, "shard").withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    right = right.select("shard", numbers("all").alias("part"), "block", "point", "v", "least")
    search = _searched(size, most, k, factor)
    keys = ("shard", "part", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: search(a, b), "point long, near long, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that the condition queries marks, its k nearest other rows.

    Nearest is the largest inner product in double precision, ties to the smaller id; score is it. factor
    relaxes both prunings: 1 is an exact search; a larger one leaves out parts whose least distance, by the
    triangle inequality, is over 1 / factor of the k-th nearest's. Each query first meets its own shard's
    part, whose k-th nearest then decides which shards it visits. Vantage points of the table are at most
    VANTAGES points, the first by a hash (their number follows the table: one for shard points); every
    point is in a shard, a shard of more points is split, and so are the queries that visit one, so no
    task holds more than a part and a block. What leaves a task are k candidates a query.

    Rows whose id or vector is null, and vectors that are empty, zero or hold null or non-finite components,
    take no part. An id that comes twice counts once, with its smallest vector, and is a query if any of
    its rows is. Vectors of different lengths never meet (over LENGTHS lengths are an error). Queries get
    all candidates where these are fewer than k, and no row where there is none. Other columns are ignored;
    an empty table gives an empty result.
    """
    if factor < 1:
        raise ValueError("factor is 1 or more")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = rows.where("id is not null and v is not null").where(F.forall("v", number) & F.exists("v", lambda x: x != 0))
    usable = usable.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    # a point has the k + 1 smallest ids of its vector: one of them may be the query's own
    first = Window.partitionBy("v").orderBy("id")
    ids = usable.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).groupBy("v").agg(F.min("id").alias("point"), F.sort_array(F.collect_list("id")).alias("ids"))
    asks = usable.where("asks").groupBy("v").agg(F.count(F.lit(1)).alias("queries"))
    points = checkpointed(ids.join(asks.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v"), "left").select("point", "v", "ids", F.coalesce("queries", F.lit(0)).cast("long").alias("queries")))
    sizes = [r[0] for r in points.select(F.size("v").alias("n")).distinct().limit(LENGTHS + 1).collect()]
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors have more than {LENGTHS} lengths")
    spark, found = vectors.sparkSession, None
    for size in sorted(sizes):
        of_length = _of_one_length(points.where(F.size("v") == size), size, k + 1, factor, shard)
        found = of_length if found is None else found.unionByName(of_length)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("point").orderBy(F.desc("score"), "near")
    found = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")
    near = found.join(points.select(F.col("point").alias("near"), "ids"), "near").select("point", "score", F.explode("ids").alias("id"))
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("point").orderBy(F.desc("score"), "id"))).where(F.col("_n") <= k + 1)
    lists = near.groupBy("point").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("id")))).alias("near"))
    lists = checkpointed(lists.join(points.select("point", "v", "queries"), "point").select("v", "near", "queries"))
    total = points.agg(F.sum("queries")).first()[0]
    is_hot = F.col("queries") * HOT > F.lit(total)
    who = usable.where("asks").select("id", F.col("v").alias("_v"))
    same = F.col("v") == F.col("_v")
    of_hot = who.join(F.broadcast(lists.where(is_hot)), same)
    of_others = who.join(lists.where(~is_hot), same)
    out = of_hot.unionByName(of_others).select(F.col("id").alias("query"), F.slice(F.filter("near", lambda s: s["id"] != F.col("id")), 1, k).alias("near"))
    out = out.select("query", F.posexplode("near").alias("pos", "s"))
    return out.select(F.col("query").alias("query_id"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("s.id").alias("vec_id"), (-F.col("s.s")).alias("score"))
