"""Places in an order over all rows, without bringing them to one task."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df parted by a hash of columns, in as many parts as shuffles have: adaptive execution leaves a number that is asked for, so a task holds no more."""
    return df.repartition(parts(df.sparkSession), *columns)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with name: 0, 1, 2, ... in that order. Rows are parted by ranges of it; a count for each part comes to the driver."""
    at, part = f"_at_{name}", f"_part_{name}"
    ranged = checkpointed(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()))
    # the id holds the part in its upper bits and the place inside it in the lower 33
    parted = ranged.withColumn(part, F.shiftright(at, 33))
    before, starts = 0, []
    for r in sorted(parted.groupBy(part).count().collect()):
        starts.append((r[0], before))
        before += r[1]
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, f"{part} long, _before long"))
    return parted.join(offsets, part).withColumn(name, F.col("_before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, part, "_before")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each of sums (whole numbers), the sum over all rows up to each one in that order, which must have no ties.

    Rows are parted by ranges of the order; the sums of each part come to the driver, one row for each.
    """
    ranged = checkpointed(df.withColumns({f"_own_{n}": c.cast("decimal(38,0)") for n, c in sums.items()}).repartitionByRange(parts(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    parted = spread(ranged.withColumn("_part", F.shiftright("_at", 33)), "_part")
    before, starts = dict.fromkeys(sums, Decimal(0)), []
    for r in sorted(parted.groupBy("_part").agg(*[F.sum(f"_own_{n}").alias(n) for n in sums]).collect()):
        starts.append((r["_part"], *before.values()))
        before = {n: before[n] + r[n] for n in sums}
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, " + ", ".join(f"_before_{n} decimal(38,0)" for n in sums)))
    up_to = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    parted = parted.join(offsets, "_part").withColumns({n: (F.col(f"_before_{n}") + F.sum(f"_own_{n}").over(up_to)).cast("decimal(38,0)") for n in sums})
    return parted.drop("_at", "_part", *[f"_{k}_{n}" for k in ("own", "before") for n in sums])
