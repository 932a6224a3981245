"""Large groups are split without writing or shuffling their rows; odd spreads of weights, ties and written forms get the shares that exact arithmetic gives."""

import random
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from tests.test_allocation import brute
from tests.test_recipe import run, table
from tieout.functions import sums
from tieout.model import table_of
from tieout.operators import ranks, steps

STEP = {"op": "allocate", "by": ["g"], "weight": "w", "total": {"column": "total"}, "column": "share", "scale": 2}


def test_rows_of_large_groups_are_not_written(spark, monkeypatch):
    kept, evaluated = [], []

    def counting(df):
        evaluated.append(df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython"))
        df = checkpointed(df)
        kept.append(df.count())
        return df

    checkpointed = steps.checkpointed
    for module in (steps, ranks):
        monkeypatch.setattr(module, "checkpointed", counting)
    monkeypatch.setattr(steps, "SMALL", 100)
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "most").otherwise("rest").alias("g"), (F.col("id") * 7919 % 1000 + 1).cast("string").alias("w"), F.concat((F.col("id") * 7919 % 1000 + 1).cast("string"), F.lit("0" * 30)).alias("far"))
    t = table_of(df, "t", ["g", "w", "far"], F.col("id"))
    split = lambda w, to: {"id": to, "by": ["g"], "weight": w, "total": {"literal": "1000.01"}, "column": to}
    made = steps.allocate(t, split("w", "a"), {})[0]
    out = steps.allocate(made, split("far", "b"), {})[0].df
    assert max(kept) < 100 and max(evaluated) == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    sums_of = out.groupBy("g").agg(F.sum(F.col("a").cast("decimal(20,2)")).alias("a"), F.sum(F.col("b").cast("decimal(20,2)")).alias("b"), F.count_if(F.col("a") != F.col("b")).alias("n")).collect()
    assert [(r.a, r.b, r.n) for r in sums_of] == [(Decimal("1000.01"), Decimal("1000.01"), 0)] * 2


@pytest.mark.parametrize("small, many", [(10_000, 100), (4, 100), (4, 2), (4, 0)])
def test_any_spread_of_weights(spark, monkeypatch, small, many):
    monkeypatch.setattr(steps, "SMALL", small)
    monkeypatch.setattr(steps, "MANY", many)
    rng = random.Random(7)
    rows = [("same", "3.33", "1")] * 150 + [(None, "0.07", "5.50")] * 40
    rows += [("a:1", "10.00", str(rng.randrange(1, 60)) + ".25") for _ in range(120)] + [("skew", "0.40", str(10 ** rng.randrange(25))) for _ in range(90)]
    rows += [("forms", "-9.99", rng.choice(["+7", "007", ".5", "-0", "3.", "2.125", "8"])) for _ in range(60)] + [("long", "123456789012345678901234567890.12", str(rng.randrange(10**40))) for _ in range(50)]
    rows += [("whole", "50.00", str(rng.randrange(1, 100))) for _ in range(100)] + [("bad", "5", "1")] * 9 + [("bad", "6", "1")] * 3 + [("once", "5.0000000000000", "3"), ("once", "5", "4"), ("even", "1.00", "1"), ("even", "1.00", "1")]
    rng.shuffle(rows)
    got = {r._row_id: r.share for r in run(table(spark, rows, ["g", "total", "w"]), STEP).output.df.collect()}
    want = brute(rows, 2)
    assert got.keys() == want.keys()
    assert {k: v and Decimal(v) for k, v in got.items()} == want


@pytest.mark.parametrize("small, many", [(4, 100), (4, 0)])
def test_rows_of_one_id_share_the_total(spark, monkeypatch, small, many):
    monkeypatch.setattr(steps, "SMALL", small)
    monkeypatch.setattr(steps, "MANY", many)
    t = table_of(spark.range(60).select(F.lit("x").alias("g"), F.lit(1).alias("w"), "id"), "t", ["g", "w"], F.col("id") % 7)
    out = steps.allocate(t, {"id": "s", "by": ["g"], "weight": "w", "total": {"literal": "0.70"}, "column": "s"}, {})[0].df
    assert sorted(r.s for r in out.collect()) == ["0.01"] * 50 + ["0.02"] * 10


def test_shares_of_nines_are_counted_up(spark):
    texts = ["0", "9", "19", "1" + "9" * 17, "9" * 40, "12" * 20, "8" * 17 + "9"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r.y for r in df.select(steps._next(F.col("x")).alias("y")).collect()] == [str(int(x) + 1) for x in texts]


def test_sums_of_numbers_of_any_shape(spark):
    rng = random.Random(3)
    numbers = ["0", "-0", ".5", "-.000000000000000000000000000001", "1" + "0" * 100, "7.", "-" + "9" * 37, "0" * 60 + "12"]
    numbers += [rng.choice(["", "-", "+"]) + str(rng.randrange(10 ** rng.randrange(1, 90))) + rng.choice(["", ".", "." + str(rng.randrange(10 ** rng.randrange(1, 90)))]) for _ in range(200)]
    df = spark.createDataFrame([(str(i % 3), x) for i, x in enumerate(numbers)], "g string, x string")
    got = {r.g: Decimal(r.x) for r in sums.grouped_sums(df, {"g": F.col("g")}, {"x": F.col("x")}, {}).collect()}
    with localcontext() as c:
        c.prec = 600
        assert got == {str(k): sum(map(Decimal, numbers[k::3])) for k in range(3)}
