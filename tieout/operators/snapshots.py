"""Digests of rows whatever their order, and of all that an output depends on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .impact import reached

#: Parts of a SHA-256 that are summed apart, 64 bits each. Of 2^64 rows a sum needs 128 bits, so DECIMAL holds those of 2^62 rows.
PARTS = 4


def _limb(sha: Column, k: int) -> Column:
    return F.conv(F.substring(sha, 16 * k + 1, 16), 16, 10).cast("decimal(38,0)")


def multiset_digest(row: Column) -> Column:
    """An aggregate: a SHA-256 of the rows of a group as a multiset.

    Each row's SHA-256 is cut into four 64-bit numbers that are summed without carry between them. Order
    doesn't matter, repeated rows count, and rows are added up where they are before anything is shuffled. Who
    can choose rows freely could build two multisets with one digest with far less work than SHA-256 needs
    (sums of hashes fall to generalised birthdays), so it tells whether inputs changed, not who is to be trusted.
    """
    sha = F.sha2(row, 256)
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[F.coalesce(F.sum(_limb(sha, k)), F.lit(0)).cast("string") for k in range(PARTS)]), 256)


def table_digests(rows: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """(table_id, n_rows, sha256) of rows(table, columns ...): nulls count as themselves."""
    text = F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in columns]))
    return rows.groupBy(F.col(table).alias("table_id")).agg(F.count(F.lit(1)).alias("n_rows"), multiset_digest(text).alias("sha256"))


def output_digests(edges: DataFrame, outputs: DataFrame, digests: DataFrame) -> DataFrame:
    """(output_id, n_inputs, known, sha256): for each output a digest of all tables that a path leads to it from.

    edges(source, target) say which table or step goes into which step, check, mapping or output; the steps of
    recipes, reviews and mappings are one graph. digests(table_id, sha256) are of the tables that hold rows. known
    is false where a path begins at something that has no digest: nothing approved may be kept then. A cycle ends
    where it begins again.
    """
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    start = outputs.select(F.col(outputs.columns[0]).alias("start"))
    into = reached(back, start).select(F.col("start").alias("output_id"), "node")
    roots = into.join(edges.select(F.col("target").alias("node")).distinct(), "node", "left_anti")
    met = roots.join(digests.select(F.col("table_id").alias("node"), "sha256"), "node", "left")
    found = met.groupBy("output_id").agg(F.count(F.lit(1)).alias("n_inputs"), F.bool_and(F.col("sha256").isNotNull()).alias("known"), multiset_digest(F.to_json(F.array("node", "sha256"))).alias("sha256"))
    out = outputs.select(F.col(outputs.columns[0]).alias("output_id")).distinct().join(found, "output_id", "left")
    return out.select("output_id", F.coalesce("n_inputs", F.lit(0)).alias("n_inputs"), F.coalesce("known", F.lit(False)).alias("known"), F.when(F.col("known"), F.col("sha256")).alias("sha256"))
