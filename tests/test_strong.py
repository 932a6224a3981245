"""Strongly connected components against reachability by brute force, and on long chains."""

import random
import time

from tieout.operators import impact, strong


def brute(edges):
    nodes = {n for e in edges for n in e}
    to = {n: {t for s, t in edges if s == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), list(to[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += to[x]
        reach[n] = seen
    return sorted((n, min([m for m in reach[n] if n in reach[m]] + [n]), n in reach[n]) for n in nodes)


def test_against_brute_force(spark):
    rng = random.Random(1)
    for n, m in ((6, 9), (30, 40)):
        edges = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)]
        edges += [(f"c{i}", f"c{(i + 1) % 5}") for i in range(5)] + [("c0", "p0"), ("p0", "p1"), ("p1", "p2"), ("p2", "n00"), ("z", "z")]
        df = spark.createDataFrame([*edges, edges[0], (None, "a"), ("a", None)], "source string, target string")
        assert sorted(map(tuple, strong.strong_components(df).collect())) == brute(set(edges))


def test_no_edges(spark):
    assert strong.strong_components(spark.createDataFrame([], "source string, target string")).collect() == []
    assert impact.cyclic(spark.createDataFrame([(None, "a")], "source string, target string")).collect() == []


def test_cycle_of_100000_nodes(spark):
    began, n = time.time(), 100_000
    ring = spark.range(n).selectExpr("id as source", f"(id + 1) % {n} as target")
    tail = spark.range(n, n + 50_000).selectExpr("id as source", "id + 1 as target")  # a long path that leads nowhere
    more = spark.createDataFrame([(5, n), (77, 3)], "source long, target long")
    got = strong.strong_components(ring.unionByName(tail).unionByName(more)).groupBy("component", "cyclic").count().where("count > 1 or cyclic").collect()
    assert [tuple(r) for r in got] == [(0, True, n)]
    assert time.time() - began < 300
