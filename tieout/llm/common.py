"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed, shared_checkpoints  # noqa: F401

#: Words are maximal runs of anything but ASCII white space, as bytes.split() also has it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z alone; lower() would change other letters too."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def packed(docs: DataFrame, id_col: str) -> DataFrame:
    """(_id, _row): each row of docs as one struct, so that no column of it clashes with an operator's own."""
    return docs.select(F.col(id_col).alias("_id"), F.struct("*").alias("_row"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, hash, row): each row of docs as one struct beside a key that no other row has, the same whenever it is read."""
    return checkpointed(docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.struct("*").alias("row")))


def one_of_each(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Of rows, as keyed gives them, one for each component of parts(key, component): with the smallest id, nulls last, then by its text's hash and key."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "key")
    first = rows.select("key", "id", "hash").join(parts, "key").groupBy("component").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col("first.key").alias("key")), "key", "left_semi").select("row.*")


#: Bits of a filter of ids, and how many of them one row of it holds.
FILTER_BITS, ROW_BITS = 1 << 26, 1 << 15


def may_have(rows: DataFrame, id_col: str, ids: DataFrame, name: str) -> DataFrame:
    """rows with name: false where id_col is surely none of ids' ids, so that such rows need no join.

    The filter is a bitmap of hashes, FILTER_BITS / 8 bytes whatever the input, and is broadcast.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    seen = ids.select(place(F.col(ids.columns[0])).alias("_p")).groupBy(F.shiftright("_p", 15).alias("_row")).agg(F.bitmap_construct_agg((F.col("_p") % ROW_BITS)).alias("_bits"))
    asked = rows.withColumn("_p", place(F.col(id_col))).withColumn("_row", F.shiftright("_p", 15))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(_p % {ROW_BITS} div 8 + 1 as int), 1)")), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, cast(_p % 8 as int))").bitwiseAND(F.lit(1)) == 1
    found = asked.join(F.broadcast(seen), "_row", "left").withColumn("_byte", byte).withColumn(name, F.coalesce(bit, F.lit(False)))
    return found.drop("_p", "_row", "_bits", "_byte")
