"""The native tier, the exact tier and sums against Python's decimals."""

import random
from decimal import ROUND_HALF_EVEN, Context, Decimal

from pyspark.sql import functions as F

from tests.test_recipe import COL, LIT, OP, codes, derived, rows, run, table
from tieout.functions import decimals

WIDE = Context(prec=400)


def numbers(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        whole, rest = "".join(rng.choices("0123456789", k=rng.choice([0, 1, 3, 12, 19, 30]))), "".join(rng.choices("0123456789", k=rng.choice([0, 2, 6, 7, 13, 20])))
        if whole or rest:
            out.append(rng.choice(["", "-", "+"]) + whole + ("." + rest if rest else ""))
    return out


def test_operations_of_any_length(spark):
    xs, ys = numbers(120, 1), numbers(120, 2)
    pairs = list(zip(xs, ys))
    t = table(spark, pairs, ["x", "y"])
    made = {"add": OP("add", COL("x"), COL("y")), "subtract": OP("subtract", COL("x"), COL("y")), "multiply": OP("multiply", COL("x"), COL("y")), "divide": OP("divide", COL("x"), COL("y"), scale=5), "both": OP("round", OP("divide", COL("x"), LIT("7")), scale=3)}
    got = rows(run(t, {"op": "derive", "columns": made}, {"op": "select", "columns": list(made)}))
    for (x, y), (a, s, m, q, r) in zip(pairs, got):
        x, y = Decimal(x), Decimal(y)
        assert a == format(WIDE.add(x, y), "f") and s == format(WIDE.subtract(x, y), "f") and m == format(WIDE.multiply(x, y), "f")
        half = lambda v, k: v.quantize(Decimal(1).scaleb(-k), rounding=ROUND_HALF_EVEN, context=WIDE)
        assert q is None if not y else Decimal(q) == half(WIDE.divide(x, y), 5)
        assert Decimal(r) == half(half(WIDE.divide(x, Decimal(7)), 12), 3)


def test_texts_around_numbers(spark):
    long = "0.12345678901234567890"
    assert derived(spark, [long, "1", None, "x"], OP("concat", LIT("<"), OP("add", COL("x"), LIT("1")), LIT(">"))) == (["<1.12345678901234567890>", "<2>", None, None], [("invalid_expression_value", "y")] * 2)
    assert derived(spark, ["9" * 102], OP("add", COL("x"), LIT("1"))) == ([None], [("invalid_expression_value", "y")])


def test_sums_and_extremes_of_any_length(spark):
    xs = [x for x in numbers(200, 3) if len(x.lstrip("+-").partition(".")[0]) <= 30]
    t = table(spark, [(str(i % 3), x) for i, x in enumerate(xs)], ["g", "x"])
    got = rows(run(t, {"op": "aggregate", "by": ["g"], "metrics": {op: {"op": op, "column": "x"} for op in ("sum", "min", "max")}}))
    for g, total, low, high in got:
        mine = [Decimal(x) for i, x in enumerate(xs) if str(i % 3) == g]
        want = Decimal(0)
        for m in mine:
            want = WIDE.add(want, m)
        assert total == format(want, "f") and Decimal(low) == min(mine) and Decimal(high) == max(mine)


def test_keys_sort_as_numbers_do(spark):
    xs = [*numbers(150, 4), "0", "-0", "0.0", "-0.00", "00.10", ".1", "1.", "1.0"]
    df = spark.createDataFrame([(x,) for x in xs], "x string")
    got = sorted((r.k, Decimal(r.x)) for r in df.select("x", decimals.order_key(F.col("x")).alias("k")).collect())
    assert all(a[1] <= b[1] and (a[0] == b[0]) == (a[1] == b[1]) for a, b in zip(got, got[1:]))


def test_wide_decimals_in_filters_sorts_and_checks(spark):
    big = "1" + "0" * 40
    t = table(spark, [(big,), ("2",), ("0.00000000000000000001",), ("x",)], ["x"])
    kept = rows(run(t, {"op": "filter", "where": {"column": "x", "operator": "gt", "value": "3", "type": "decimal"}}))
    assert [x for (x,) in kept] == [big, "x"]
    assert [x for (x,) in rows(run(t, {"op": "sort", "by": [{"column": "x", "type": "decimal"}]}))] == ["0.00000000000000000001", "2", big, "x"]
    r = run(table(spark, [(big,), ("0.5",)], ["x"]), checks=[{"type": "total", "column": "x", "expected": big[:-1] + "1", "tolerance": "0.5"}])
    assert [c.passed for c in r.checks.collect()] == [True] and not codes(r)


def test_allocation_with_fine_scales_and_weights(spark):
    t = table(spark, [("a", "0.000000000001"), ("b", "0.000000000002")], ["k", "w"])
    r = run(t, {"op": "allocate", "weight": "w", "total": LIT("1"), "column": "s", "scale": 12})
    assert [x for _, _, x in rows(r)] == ["0.333333333333", "0.666666666667"]


def test_sums_of_any_length(spark):
    import random
    from decimal import Context, Decimal

    from tieout.functions import sums

    exact, rng = Context(prec=600), random.Random(3)
    rows = []
    for g in range(6):
        for _ in range(40):
            size = rng.choice([1, 5, 18, 19, 60, 101])
            text = rng.choice(["", "-", "+"]) + str(rng.randrange(10**size))
            if g % 2:
                text += "." + "".join(rng.choices("0123456789", k=rng.choice([1, 11, 12, 13, 60, 120])))
            rows.append((str(g), text))
    rows += [("none", None), ("none", "x"), ("null", "5"), (None, "9" * 101), (None, "1"), ("hi", "-999999999999999999.5"), ("hi", "-0.5"), ("far", "9" * 101), ("far", "0." + "1" * 200)]
    df = spark.createDataFrame(rows, "g string, x string")
    got = {r.g: (r.total, r.n) for r in sums.grouped_sums(df, {"g": F.col("g")}, {"total": F.col("x")}, {"n": F.count(F.lit(1))}).collect()}
    for g in {r[0] for r in rows} - {"far"}:
        total, digits = Decimal(0), 0
        for x in [x for k, x in rows if k == g and x and x != "x"]:
            total, digits = exact.add(total, Decimal(x)), max(digits, len(x.partition(".")[2]))
        assert got[g] == (format(total.quantize(Decimal(1).scaleb(-digits), context=exact), "f") if got[g][0] != "0" else "0", sum(k == g for k, _ in rows)), g
    assert got["far"] == (None, 2) and got["none"] == ("0", 2) and len(got["0"][0]) > 95
    one = sums.grouped_sums(df.where("g = '1'"), {}, {"a": F.col("x"), "b": F.concat("x", F.lit("0"))}, {}).first()
    assert (one.a, one.b) == (got["1"][0], got["1"][0] + "0") and sums.grouped_sums(df.limit(0), {}, {"a": F.col("x")}, {}).first().a == "0"


def test_numbers_out_of_range(spark):
    from tieout.functions import exact

    texts = ["9" * 101, "9" * 102, "0." + "0" * 99 + "1", "0." + "0" * 100 + "1", "0." + "0" * 100, "0." + "0" * 101, "." + "0" * 150 + "7", "-1." + "0" * 150, "0" * 150, "1." + "0" * 120 + "1"]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", decimals.error(F.col("x")).alias("e")).collect()
    for r in got:
        try:
            exact._plain(r.x)
            assert r.e is None, r.x
        except exact.Fault as fault:
            assert r.e == str(fault), r.x
