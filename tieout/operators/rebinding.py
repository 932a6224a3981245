"""Configurations after a new revision: which tables carry on an old one, and signatures that tell whether a rule still means the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import digest

#: Rows of a table among which its header is looked for.
HEADER_ROWS = 30


def signature(*columns: Column | str) -> Column:
    """What a table is, whatever its id: its document, its title and its columns in order."""
    return digest(*[F.col(c) if isinstance(c, str) else c for c in (columns or ("document_id", "title", "columns"))])


def headers_asked(old: DataFrame, old_rows: DataFrame, references: DataFrame) -> DataFrame:
    """(table_id, header_row_id, values): the header rows that rules name, or the first row of a table of which no rule names one.

    references(table_id, header_row_id, confirmed): a rule's table; confirmed with a null header says that it has none.
    """
    named = references.where("confirmed").select("table_id", "header_row_id").distinct()
    first = old_rows.groupBy("table_id").agg(F.min_by("row_id", "pos").alias("header_row_id"))
    left = old.select("table_id").join(named.select("table_id"), "table_id", "left_anti").join(first, "table_id", "left")
    asked = named.join(old.select("table_id"), "table_id", "left_semi").unionByName(left)
    values = old_rows.select("table_id", F.col("row_id").alias("header_row_id"), "values")
    return asked.join(values, ["table_id", "header_row_id"], "left").select("table_id", "header_row_id", "values")


def rebound(old: DataFrame, new: DataFrame, old_rows: DataFrame, new_rows: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((table_id, status, new_table_id, n_candidates), (table_id, header_row_id, new_header_row_id)) for each retired table.

    old and new(table_id, document_id, title, columns) are the tables of two revisions, their rows
    (table_id, row_id, pos, values). A table is kept if one new table has its signature and each header that
    rules ask of it is found in exactly one of the new table's first rows, with the same values: letters of
    columns alone don't tell that their meaning is unchanged. Else it is withdrawn (no candidate), ambiguous
    (several), headerless (a rule says that it has no header) or changed. Joins are by signature and by the
    header's values; nothing is compared pair by pair.
    """
    keyed = lambda df, name: df.select(F.col("table_id").alias(name), signature().alias("_is"))
    candidates = keyed(new, "new_table_id").groupBy("_is").agg(F.count(F.lit(1)).alias("n_candidates"), F.min("new_table_id").alias("new_table_id"))
    met = keyed(old, "table_id").join(candidates, "_is", "left").drop("_is").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    asked = headers_asked(old, old_rows, references)
    head = Window.partitionBy("table_id").orderBy("pos", "row_id")
    top = new_rows.withColumn("_n", F.row_number().over(head)).where(F.col("_n") <= HEADER_ROWS).select(F.col("table_id").alias("new_table_id"), F.to_json("values").alias("_v"), F.col("row_id").alias("new_header_row_id"))
    alike = top.groupBy("new_table_id", "_v").agg(F.count(F.lit(1)).alias("_n"), F.min("new_header_row_id").alias("new_header_row_id"))
    found = asked.join(met.where("n_candidates = 1").select("table_id", "new_table_id"), "table_id").withColumn("_v", F.to_json("values")).join(alike, ["new_table_id", "_v"], "left")
    fine = (F.col("_n") == 1) & F.col("values").isNotNull()
    verdict = found.groupBy("table_id").agg(F.bool_or(F.col("header_row_id").isNull()).alias("_none"), F.bool_and(F.coalesce(fine, F.lit(False))).alias("_same"))
    status = (
        F.when(F.col("n_candidates") == 0, "withdrawn").when(F.col("n_candidates") > 1, "ambiguous").when(F.col("_none"), "headerless").when(F.col("_same"), "kept").otherwise("changed")
    )
    tables = met.join(verdict, "table_id", "left").withColumn("status", status)
    tables = tables.select("table_id", "status", F.when(F.col("status") == "kept", F.col("new_table_id")).alias("new_table_id"), "n_candidates")
    headers = found.join(tables.where("status = 'kept'").select("table_id"), "table_id", "left_semi").select("table_id", "header_row_id", "new_header_row_id")
    return tables, headers


def carried(references: DataFrame, tables: DataFrame, headers: DataFrame) -> DataFrame:
    """references with the ids of the tables and headers that carry on theirs, and rebound: whether they are new."""
    kept = tables.where("status = 'kept'").select("table_id", "new_table_id")
    met = references.join(kept, "table_id", "left").join(headers.withColumnRenamed("header_row_id", "_h"), ["table_id"], "left").where("_h is null or header_row_id is null or _h = header_row_id")
    met = met.withColumns({"rebound": F.col("new_table_id").isNotNull(), "header_row_id": F.when(F.col("header_row_id").isNotNull(), F.coalesce("new_header_row_id", "header_row_id"))})
    return met.withColumn("table_id", F.coalesce("new_table_id", "table_id")).select(*references.columns, "rebound").distinct()


def rule_signatures(rules: DataFrame, tables: DataFrame, rows: DataFrame) -> DataFrame:
    """(rule_id, signature): what rules mean, so that equal signatures in two revisions stand for the same rule.

    rules(rule_id, part, table_id, header_row_id, confirmed, settings) has a row for each table that a rule reads;
    settings is its canonical JSON without titles and rationales. Ids of tables and rows are replaced by the
    table's signature and the header's values, so only a change of meaning changes a signature.
    """
    of = tables.select("table_id", signature().alias("_is"))
    values = rows.select("table_id", F.col("row_id").alias("header_row_id"), F.to_json("values").alias("_v"))
    met = rules.join(of, "table_id", "left").join(values, ["table_id", "header_row_id"], "left")
    selection = F.when(~F.col("confirmed"), "unconfirmed").when(F.col("header_row_id").isNull(), "no header").otherwise("explicit row")
    part = F.struct(F.col("part"), F.coalesce("_is", "table_id").alias("is"), selection.alias("selection"), F.when(F.col("confirmed"), F.col("_v")).alias("values"), F.col("settings"))
    parts = met.groupBy("rule_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))  # a rule reads few tables
    return parts.select("rule_id", digest(F.col("parts")).alias("signature"))
