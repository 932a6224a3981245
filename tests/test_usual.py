"""Cells that are usual are told by one pattern; odd ones are read as before."""

from pyspark.sql import functions as F

from tieout.functions import cleaning, decimals, sums
from tieout.operators.checks import stripped


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c"))).first()[0]


def test_usual_and_odd_cells(spark):
    amounts = {"12.50": "12.50", " 12.50 ": "12.50", "12.50\n": "12.50", "(5)": "-5", "1,234.5": "1234.5", "1,5": None, "1e3": None, "-": None, "": None, "-0007": "-0007"}
    assert {k: one(spark, k, cleaning.amount_text) for k in amounts} == amounts
    assert one(spark, "12.50", lambda c: cleaning.amount_text(c, "comma_decimal")) == "1250"
    days = {"2024-02-29": "2024-02-29", "2023-02-29": None, "2024-02-29\n": "2024-02-29", "2024-02-29T10:00": "2024-02-29", "3 Feb 2024": "2024-02-03", "": "", "0099-01-01": "0099-01-01"}
    assert {k: one(spark, k, cleaning.date_text) for k in days} == days
    assert {k: one(spark, k, stripped) for k in (" a b\n", "a b", " a", "a\n", "")} == {" a b\n": "a b", "a b": "a b", " a": "a", "a\n": "a", "": ""}
    assert [one(spark, k, cleaning.pack_number) for k in ("12.5", "(1,200)", "NA", "1.", "1e2")] == ["12.5", "-1200", None, "invalid", "100"]
    assert [one(spark, k, decimals.error) for k in ("1", "0" * 300 + "1", "x", None, "9" * 102)] == [None, "not_a_decimal", "not_a_decimal", "missing_value", "number_too_long"]
    keys = [one(spark, k, decimals.order_key) for k in ("-5", "0", "0.5", "05", "9", "10", "1" * 40)]
    assert keys == sorted(keys) and keys[3] == one(spark, "5", decimals.order_key) == one(spark, "5.0", decimals.order_key)


def test_sums_try_each_pattern_once(spark):
    df = spark.createDataFrame([("a", "1.5")], "g string, x string")
    plan = sums.grouped_sums(df, {"g": F.col("g")}, {"x": F.col("x")}, {})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(x#") <= 4
