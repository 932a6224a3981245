"""Nearest vectors against brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tieout.llm import nearest, queries


def brute(rows, k, asks):
    best = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            best[i] = min(best.get(i, v), v)
    out = []
    for i, v in best.items():
        if asks(i):
            scored = []
            for j, w in best.items():
                if j != i and len(w) == len(v):
                    s = 0.0
                    for a, b in zip(v, w):
                        s += float(a) * float(b)
                    scored.append((-s, j))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"point": F.lit("x"), "v": F.lit(1), "id": F.lit(None), "shard": F.lit(0)})


def vectors(rng, n, size=6):
    return [np.float32(v).tolist() for v in rng.standard_normal((n, size)) * rng.uniform(0.1, 3, (n, 1))]


@pytest.mark.parametrize("shard, block, leaf", [(4096, 4096, 64), (30, 7, 8)])
def test_exact_at_factor_one(spark, monkeypatch, shard, block, leaf):
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "LEAF", leaf)
    rng = np.random.default_rng(shard)
    some = vectors(rng, 150)
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [nan] * 6, [inf, 1.0, 1.0, 1.0, 1.0, 1.0], [1.0, 2.0], [2.0, 1.0], [3.0], [-0.0, 0.0, 1.0, 0.0, 0.0, 0.0], [0.0, -0.0, 1.0, 0.0, 0.0, 0.0]]
    rows = list(enumerate(some + odd + [some[0]] * 60))  # many equal vectors, among queries too
    rows += [(20, some[3]), (20, some[20]), (40, some[40]), (None, some[1]), (None, None), (-20, some[2])]
    got = nearest.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=7, factor=1.0, shard=shard)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 7, lambda i: i % 20 == 0)


def test_few_and_none(spark):
    by = F.col("vec_id") >= 0
    assert nearest.nearest(table(spark, []), by).collect() == []
    assert nearest.nearest(table(spark, [(1, [1.0, 2.0])]), by).collect() == []
    assert nearest.nearest(table(spark, [(1, None), (2, [0.0])]), by).collect() == []
    three = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0])]
    assert sorted(map(tuple, nearest.nearest(table(spark, three), by).collect())) == brute(three, 20, lambda i: True)
    with pytest.raises(ValueError):
        nearest.nearest(table(spark, three), by, factor=0.5)


def test_one_vector_for_a_third(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate(vectors(rng, 400, 4) + [[1.0, 2.0, 3.0, 4.0]] * 4000))
    got = nearest.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=5, factor=1.0, shard=64)
    mine = {r.query_id for r in got.collect()}
    assert mine == set(range(0, 4400, 20))
    of_copies = got.where("query_id >= 420").groupBy("vec_id").count().collect()
    assert {r.vec_id for r in of_copies} <= {400, 401, 402, 403, 404} | set(range(400))


def test_factor_prunes(spark):
    """On vectors in groups the factor of the query leaves most of the table unseen and loses next to nothing."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 16))
    x = (centres[rng.integers(0, 40, 8000)] + 0.25 * rng.standard_normal((8000, 16))).astype(np.float32).astype(float)
    most = float(np.sqrt((x * x).sum(1).max()))
    tree = nearest.VantageTree(x, np.arange(len(x)), most)
    q = x[::20]
    want = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :20]
    recalls, shares = [], []
    for factor in (1.0, nearest.FACTOR, 3.0, 6.0):
        rows, _, share = tree.search(q, 20, np.full(len(q), -np.inf), factor)
        recalls.append(np.mean([len(set(a) & set(b)) / 20 for a, b in zip(rows.tolist(), want.tolist())]))
        shares.append(share)
    assert recalls[0] == 1.0 and recalls[1] >= 0.99 and shares == sorted(shares, reverse=True) and shares[1] < 0.9 * shares[0], (recalls, shares)


def test_query_and_sql(spark, tmp_path):
    rng = np.random.default_rng(6)
    spark.createDataFrame(list(enumerate(vectors(rng, 300, 8) + [None])), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op12_nearest"]).fetchall()
    got = queries.op12_nearest(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    exact = {(r[0], r[2]): r[3] for r in want}
    both = [r for r in got if (r.query_id, r.vec_id) in exact]
    assert len(got) == len(want) == 300 and len(both) >= 0.98 * len(want)
    assert all(exact[r.query_id, r.vec_id] == r.score for r in both)
