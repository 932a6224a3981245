"""Which columns look like lists that others refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """(table, column, value, n) of the trimmed values that are no blanks."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns])
    return df.select(F.inline(cells)).where("value is not null and value <> ''").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(table))


def suggested_references(values: DataFrame, least: float = 0.2) -> DataFrame:
    """(left_table, left_column, right_table, right_column, shared, left_values, right_values) where the right column
    has each value once and at least that share of the left column's values. Values meet in one join on the value."""
    sizes = values.groupBy("table", "column").agg(F.count(F.lit(1)).alias("size"), F.max("n").alias("most"))
    lists = sizes.where("most = 1").select("table", "column")
    left = values.select(F.col("table").alias("left_table"), F.col("column").alias("left_column"), "value")
    right = values.join(F.broadcast(lists), ["table", "column"]).select(F.col("table").alias("right_table"), F.col("column").alias("right_column"), "value")
    met = left.join(right, "value").where("left_table <> right_table").groupBy("left_table", "left_column", "right_table", "right_column").agg(F.count(F.lit(1)).alias("shared"))
    l = sizes.select(F.col("table").alias("left_table"), F.col("column").alias("left_column"), F.col("size").alias("left_values"))  # noqa: E741
    r = sizes.select(F.col("table").alias("right_table"), F.col("column").alias("right_column"), F.col("size").alias("right_values"))
    return met.join(F.broadcast(l), ["left_table", "left_column"]).join(F.broadcast(r), ["right_table", "right_column"]).where(F.col("shared") >= least * F.col("left_values"))
