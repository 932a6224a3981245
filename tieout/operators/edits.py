"""People's edits: overlays that make a new version of a table and never touch the old one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..model import POS, ROW, Table, row_id


def set_cells(table: Table, corrections: DataFrame) -> Table:
    """corrections(row_id, column_key, value, seq): the last of each cell counts, a null too."""
    last = corrections.groupBy("row_id", "column_key").agg(F.max_by(F.struct("value"), "seq").alias("s"))
    wide = last.groupBy(F.col("row_id").alias("_of")).pivot("column_key", list(table.keys)).agg(F.first("s"))
    df = table.df.join(wide.select("_of", *[F.col(f"`{k}`").alias(f"_new_{i}") for i, k in enumerate(table.keys)]), F.col(ROW) == F.col("_of"), "left")
    return table.with_df(df.select(ROW, POS, *[F.when(F.col(f"_new_{i}").isNotNull(), F.col(f"_new_{i}.value")).otherwise(F.col(f"`{k}`")).alias(k) for i, k in enumerate(table.keys)]))


def provenance(table: Table, corrections: DataFrame, made: DataFrame | None = None, effective: Table | None = None) -> DataFrame:
    """(row_id, column_key, original, effective, corrected_by, reason [, original_available]): the corrected cells of a table, with the last correction of each that still counts.

    corrections(row_id, column_key, value, seq, actor_id, reason). made(row_id, seq) are rows that a split or
    a merge made, each with the number of that edit in the same order: every cell was replaced by it, so
    corrections from before are history and explain nothing, even where a value is the same, and such a
    row has no original of its own. effective is the table after all edits: a correction holds only while its
    value is the cell's. Without effective the last correction's value is.
    """
    counted = corrections
    if made is not None:
        since = made.groupBy("row_id").agg(F.max("seq").alias("_since"))
        counted = corrections.join(since, "row_id", "left").where("_since is null or seq > _since").drop("_since")
    last = counted.groupBy("row_id", "column_key").agg(F.max_by(F.struct("value", "actor_id", "reason"), "seq").alias("c"))
    long = lambda t, name: t.df.select(F.col(ROW).alias("row_id"), F.inline(F.array(*[F.struct(F.lit(k).alias("column_key"), F.col(f"`{k}`").alias(name)) for k in t.keys])))
    if made is None and effective is None:
        return long(table, "original").join(last, ["row_id", "column_key"]).select("row_id", "column_key", "original", F.col("c.value").alias("effective"), F.col("c.actor_id").alias("corrected_by"), F.col("c.reason").alias("reason"))
    now = long(effective or table, "effective")
    cells = now.join(long(table, "original").withColumn("_there", F.lit(True)), ["row_id", "column_key"], "left").join(last, ["row_id", "column_key"], "left")
    if made is not None:
        cells = cells.join(since.withColumn("_new", F.lit(True)).drop("_since"), "row_id", "left")
    else:
        cells = cells.withColumn("_new", F.lit(None).cast("boolean"))
    available = F.coalesce("_there", F.lit(False)) & F.col("_new").isNull()
    holds = F.col("c").isNotNull() & F.col("c.value").eqNullSafe(F.col("effective")) & F.col("c.actor_id").isNotNull()
    return cells.select(
        "row_id", "column_key", F.when(available, F.col("original")).alias("original"), "effective", F.when(holds, F.col("c.actor_id")).alias("corrected_by"), F.when(holds, F.col("c.reason")).alias("reason"), available.alias("original_available"),
    )


def rename_column(table: Table, key: str, label: str) -> Table:
    """Another label; the key stays."""
    if key not in table.keys or not label.strip():
        raise ValueError("a known column gets a label")
    return Table(table.table_id, table.df, table.keys, table.labels | {key: label}, table.title, table.inputs)


def mark_unresolved(issues: DataFrame, table_id: str, row: str, column: str | None, reason: str) -> DataFrame:
    """issues(issue_id, table_id, row_id, column_key, code, severity, resolved, by_person) with one that a person raised."""
    if not reason.strip():
        raise ValueError("a reason is wanted")
    spark = issues.sparkSession
    one = spark.range(1).select(row_id("person", table_id, row, column, reason).alias("issue_id"), F.lit(table_id).alias("table_id"), F.lit(row).alias("row_id"), F.lit(column).cast("string").alias("column_key"), F.lit("marked_unresolved").alias("code"), F.lit("error").alias("severity"), F.lit(False).alias("resolved"), F.lit(True).alias("by_person"))
    return issues.unionByName(one.join(issues.select("issue_id"), "issue_id", "left_anti").select(*issues.columns))


def resolve_issues(issues: DataFrame, ids: list[str]) -> DataFrame:
    """issues with those resolved that people raised; the parsers' own are resolved by repairs alone."""
    return issues.withColumn("resolved", F.col("resolved") | (F.col("issue_id").isin(*ids) & F.col("by_person")))


#: Codes of parsers' issues that corrections of cells repair.
REPAIRABLE = ("spreadsheet_error", "formula_cache_missing", "citation_missing", "table_unresolved")


def repaired(issues: DataFrame, scope: DataFrame, corrections: DataFrame) -> DataFrame:
    """issues with resolved for those of REPAIRABLE all of whose cells people corrected, and open again for those of which not all are any more.

    scope(issue_id, row_id, column_key) lists the cells that an issue is about; issues have n_cells, how many
    there must be, so that lost cells repair nothing. corrections(row_id, column_key, actor_id, ...).
    """
    done = corrections.where("actor_id is not null").select("row_id", "column_key").distinct().withColumn("_done", F.lit(True))
    cells = scope.distinct().join(done, ["row_id", "column_key"], "left").groupBy("issue_id").agg(F.count(F.lit(1)).alias("_n"), F.count("_done").alias("_fixed"))
    rows = issues.join(cells, "issue_id", "left")
    fine = F.coalesce((F.col("_n") == F.col("n_cells")) & (F.col("_fixed") == F.col("_n")), F.lit(False))
    mine = F.col("code").isin(*REPAIRABLE)
    return rows.withColumn("resolved", F.when(mine, fine).otherwise(F.col("resolved"))).select(*issues.columns)


def set_citations(locators: DataFrame, corrections: DataFrame) -> DataFrame:
    """locators(row_id, column_key, page, bbox) with the last box that corrections(row_id, column_key, page, bbox, seq) give; a null column means the row's whole block."""
    fine = (F.size("bbox") == 4) & F.forall("bbox", lambda x: (x >= 0) & (x <= 1)) & (F.col("bbox")[0] < F.col("bbox")[2]) & (F.col("bbox")[1] < F.col("bbox")[3]) & (F.col("page") >= 1)
    good = corrections.where(fine)
    last = lambda df, *by: df.groupBy(*by).agg(F.max_by(F.struct("seq", "page", "bbox"), "seq").alias("c"))
    own = last(good.where("column_key is not null"), "row_id", "column_key").withColumnRenamed("c", "_own")
    whole = last(good.where("column_key is null"), "row_id").withColumnRenamed("c", "_whole")
    rows = locators.join(own, ["row_id", "column_key"], "left").join(whole, "row_id", "left")
    new = F.when(F.coalesce(F.col("_own.seq"), F.lit(-1)) >= F.coalesce(F.col("_whole.seq"), F.lit(-1)), F.col("_own")).otherwise(F.col("_whole"))
    return rows.withColumn("_new", new).select("row_id", "column_key", F.coalesce("_new.page", "page").alias("page"), F.coalesce("_new.bbox", "bbox").alias("bbox"))


def exclude_rows(table: Table, excluded: DataFrame) -> Table:
    """Without the rows of excluded(row_id, reason); each needs a reason."""
    return table.with_df(table.df.join(excluded.where("trim(coalesce(reason, '')) <> ''").select(F.col("row_id").alias(ROW)).distinct(), ROW, "left_anti"))


def set_header(table: Table, row: str) -> Table:
    """The row's cells as labels; the row itself is left out."""
    found = table.df.where(F.col(ROW) == row).select(*[F.col(f"`{k}`") for k in table.keys]).head(1)
    if not found:
        raise ValueError(f"no row {row}")
    labels = {k: v for k, v in zip(table.keys, found[0]) if v}
    out = table.with_df(table.df.where(F.col(ROW) != row))
    return Table(out.table_id, out.df, out.keys, table.labels | labels, out.title)


def split_row(table: Table, row: str, parts: list[dict[str, str | None]]) -> Table:
    """The row replaced by 2 to 20 explicit ones, in its place."""
    if not 2 <= len(parts) <= 20 or any(set(p) - set(table.keys) for p in parts):
        raise ValueError("a row is split into 2 to 20 rows of known columns")
    cells = F.array(*[F.struct(F.lit(i).alias("_i"), *[F.lit(p.get(k)).cast("string").alias(k) for k in table.keys]) for i, p in enumerate(parts)])
    spaced = table.df.withColumn(POS, F.col(POS) * 32)
    new = spaced.where(F.col(ROW) == row).select(ROW, POS, F.explode(cells).alias("_p")).select(row_id("split", F.col(ROW), F.col("_p._i").cast("string")).alias(ROW), (F.col(POS) + F.col("_p._i")).alias(POS), *[F.col(f"_p.`{k}`").alias(k) for k in table.keys])
    return table.with_df(spaced.where(F.col(ROW) != row).unionByName(new))


def merge_rows(table: Table, rows: list[str]) -> tuple[Table, DataFrame]:
    """(table, conflicts(column_key)): 2 to 20 rows as one; a cell with several different values becomes null and a conflict."""
    if not 2 <= len(set(rows)) <= 20:
        raise ValueError("2 to 20 rows are merged")
    mine = F.col(ROW).isin(*rows)
    sets = table.df.where(mine).agg(F.min(POS).alias(POS), *[F.collect_set(F.when(F.trim(F.col(f"`{k}`")) != "", F.col(f"`{k}`"))).alias(k) for k in table.keys])
    one = sets.where(F.col(POS).isNotNull()).select(row_id("merge", *sorted(rows)).alias(ROW), POS, *[F.when(F.size(f"`{k}`") == 1, F.get(f"`{k}`", F.lit(0))).alias(k) for k in table.keys])
    clash = F.array_compact(F.array(*[F.when(F.size(f"`{k}`") > 1, F.lit(k)) for k in table.keys]))
    return table.with_df(table.df.where(~mine).unionByName(one)), sets.select(F.explode(clash).alias("column_key"))


def narrative_parents(table: Table, is_record: Column) -> DataFrame:
    """(row id, parent): rows without a record of their own go with the last record before them.

    The carry is by range partitions: the last record of each is brought to the next, so no task sees all rows.
    """
    parts = checkpointed(table.df.select(ROW, POS, F.when(is_record, F.col(ROW)).alias("_own")).repartitionByRange(F.col(POS)).withColumn("_part", F.spark_partition_id()))
    tails = parts.where("_own is not null").groupBy("_part").agg(F.max_by("_own", POS).alias("_tail")).withColumnRenamed("_part", "_before")
    inside = F.last("_own", ignorenulls=True).over(Window.partitionBy("_part").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0))
    # a row for each part: the last record of the parts before it
    heads = parts.select("_part").distinct().join(tails, F.col("_part") == F.col("_before"), "left")
    carry = heads.select("_part", F.last("_tail", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    return parts.withColumn("_here", inside).join(F.broadcast(carry), "_part").select(ROW, F.coalesce("_here", "_carry").alias("parent"))


def without_blank(table: Table) -> Table:
    some = reduce(Column.__or__, [F.trim(F.coalesce(F.col(f"`{k}`"), F.lit(""))) != "" for k in table.keys])
    return table.with_df(table.df.where(some))
