"""What people look through: findings by text and kind, and tables by page or by the page that a row is on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import POS, ROW, Table
from .ranks import numbered

PAGE = 50


def ordered(findings: DataFrame, checks: list[str]) -> DataFrame:
    """findings with place: by check, in the order in which checks are declared, then by key; parted by ranges."""
    index = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in checks] or [F.lit("")]), F.col("check_id")), F.lit(0))
    return numbered(findings, [F.when(index > 0, index).otherwise(len(checks) + 1).asc(), F.col("check_id").asc_nulls_last(), F.col("key").asc_nulls_last(), F.col("match_key").asc_nulls_last()], "place")


def has_text(df: DataFrame, text: str) -> Column:
    """Whether the text stands anywhere in a row as JSON, names of columns included, whatever the case."""
    return F.lower(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).contains(text.lower()) if text else F.lit(True)


def results(findings: DataFrame, checks: list[str], text: str = "", status: str | None = None, blocking: bool | None = None, offset: int = 0, limit: int = PAGE) -> tuple[DataFrame, int]:
    """(a page of the findings with their places, how many there are in all) of those that hold the text, the status and whether they block."""
    if offset < 0 or limit < 1:
        raise ValueError("a page begins at 0 or later and has a row at least")
    found = findings.where(has_text(findings, text))
    if status is not None:
        found = found.where(F.col("status") == status)
    if blocking is not None:
        found = found.where(F.coalesce("blocking", F.lit(True)) == blocking)
    placed = ordered(found, checks)
    return placed.where((F.col("place") >= offset) & (F.col("place") < offset + limit)), placed.count()


def page(table: Table, limit: int = PAGE, offset: int = 0, row: str | None = None) -> tuple[DataFrame, int, int]:
    """(rows with their places, the offset, how many rows there are): a page, or the one that a row is on; LookupError if it isn't there.

    Places are worked out by ranges of rows; of the row asked for one number comes to the driver.
    """
    if offset < 0 or limit < 1:
        raise ValueError("a page begins at 0 or later and has a row at least")
    placed = numbered(table.df, [F.col(POS).asc(), F.col(ROW).asc()], "place")
    if row is not None:
        at = placed.where(F.col(ROW) == row).select("place").take(1)
        if not at:
            raise LookupError(row)
        offset = at[0][0] // limit * limit
    return placed.where((F.col("place") >= offset) & (F.col("place") < offset + limit)), offset, placed.count()
