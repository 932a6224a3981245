"""Impact beyond any fixed number of rounds."""

from tieout.operators import impact


def test_chain_of_100_nodes_is_walked_to_its_end(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(99)], "source string, target string")
    got = impact.reached(edges, spark.createDataFrame([("n0",)], "start string")).collect()
    assert sorted((r.node, r.depth) for r in got) == sorted((f"n{i}", i) for i in range(1, 100))


def test_cycle_of_100_nodes_is_reported(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 100}") for i in range(100)] + [("a", "n0"), ("n5", "b"), ("b", "c")], "source string, target string")
    assert sorted(r.node for r in impact.cyclic(edges).collect()) == sorted(f"n{i}" for i in range(100))
