"""Parts that are asked for stay as many, however small they are."""

from pyspark.sql import functions as F

from tieout.operators import pack, ranks


def test_parts_are_not_put_together(spark):
    n = ranks.parts(spark)
    df = ranks.spread(spark.range(5000), "id")
    assert df.groupBy("id").count().rdd.getNumPartitions() == n > 1
    got = ranks.running(spark.range(100).withColumn("x", F.lit(2)), [F.col("id")], {"s": F.col("x")})
    assert [int(r.s) for r in got.orderBy("id").collect()] == [2 * i + 2 for i in range(100)]


def test_corrections_are_grouped_in_many_parts(spark):
    scope = "entity_id string, period string, currency string"
    facts = spark.createDataFrame([(i, 1, "10", "E", "2024", "EUR", "RESOLVED") for i in range(40)], f"fact_id int, version int, value_decimal string, {scope}, status string")
    made = spark.createDataFrame([(i, 1, "11.5", "E", "2024", "EUR", "s") for i in range(40)] * 2, f"fact_id int, version int, value_decimal string, {scope}, source_id string")
    seen = spark.createDataFrame([("s", i, "E", "2024", "EUR") for i in range(20)] * 2, f"source_id string, fact_id int, {scope}")
    now, refused = pack.corrected(facts, made, seen)
    assert refused.rdd.getNumPartitions() == ranks.parts(spark)
    assert now.where("version = 2").count() == 20 and [(r.code, r.n) for r in refused.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()] == [("not_supported", 20)]
