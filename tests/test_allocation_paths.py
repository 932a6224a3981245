"""Groups that are placed by windows and by ranges get the same shares; limbs are cut from a column of digits."""

from pyspark.sql import functions as F

from tieout.functions import sums
from tieout.model import table_of
from tieout.operators import steps


def test_both_ways_give_the_same(spark, monkeypatch):
    t = table_of(spark.createDataFrame([(i, "ab"[i % 5 == 0], str(i % 4 + 1)) for i in range(20)], "p int, g string, w string"), "t", ["g", "w"], F.col("p"))
    got = []
    for small in (10_000, 5, 0):
        monkeypatch.setattr(steps, "SMALL", small)
        out = steps.allocate(t, {"id": "s", "by": ["g"], "weight": "w", "total": {"literal": "10.01"}, "column": "x"}, {"t": t})[0].df
        got.append(sorted((r._pos, r.x) for r in out.collect()))
    assert got[0] == got[1] == got[2] and sum(round(float(x) * 100) for _, x in got[0]) == 2002


def test_limbs_are_cut_from_a_column(spark):
    df = spark.createDataFrame([("a", "1" * 40)], "g string, x string")
    plan = sums.grouped_sums(df, {"g": F.col("g")}, {"x": F.col("x")}, {})._jdf.queryExecution().analyzed().toString()
    assert "_t0" in plan
