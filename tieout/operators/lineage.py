"""Where the cells of a table come from: rows and columns of source tables, worked out only when asked for.

Steps note which rows went into which and which columns a column was made of. Most keep their rows' ids, so
their notes are put together on the driver; where rows were joined, grouped or reshaped, the notes are
tables of row ids, which are joined. No list of rows is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ROW, Table

@dataclass(frozen=True)
class Path:
    """A source table, the rows of it that went into which (None: the same ids), and for each column those that it was made of.

    one_out: a source row goes into one row at most; one_source: a row is made of one source row at most;
    once: no pair of rows comes twice.
    """

    source: Table
    links: DataFrame | None
    columns: dict[str, tuple[str, ...]]
    one_out: bool = True
    one_source: bool = True
    once: bool = True


def paths(table: Table) -> list[Path]:
    if not table.inputs:
        return [Path(table, None, {k: (k,) for k in table.keys})]
    found: list[Path] = []
    for step in table.inputs:
        one_out, one_source = step.links is None or step.gathers, step.links is None or not step.gathers
        for p in paths(step.table):
            through = {k: tuple(dict.fromkeys(c for m in made for c in p.columns.get(m, ()))) for k, made in step.columns.items()}
            through = {k: c for k, c in through.items() if c}
            if through:  # a pair comes twice only by two rows between, which either side may rule out
                found.append(Path(p.source, _joined(step.links, p.links), through, one_out and p.one_out, one_source and p.one_source, p.once and (p.one_out or one_source)))
    return found


def _joined(first: DataFrame | None, second: DataFrame | None) -> DataFrame | None:
    if first is None or second is None:
        return second if first is None else first
    return first.withColumnRenamed("source", "_mid").join(second.withColumnRenamed("out", "_mid"), "_mid").select("out", "source")


def lineage(table: Table, keys: list[str] | None = None) -> DataFrame:
    """(row_id, column_key, source_table, source_row, source_column): a row for each source cell of each cell, once.

    Rows are held against each other only where a cell could come twice: on a path that parts and meets again,
    or by two paths that have columns in common. Groups, whatever their size, need neither.
    """
    out, seen, again = None, set(), False
    for p in paths(table):
        pairs = [(k, c) for k, made in p.columns.items() if keys is None or k in keys for c in made]
        if not pairs:
            continue
        rows = table.df.select(F.col(ROW).alias("out"), F.col(ROW).alias("source")) if p.links is None else p.links.join(table.df.select(F.col(ROW).alias("out")), "out", "left_semi")
        rows = rows if p.once else rows.distinct()
        mine = {(p.source.table_id, *pair) for pair in pairs}
        again, seen = again or bool(seen & mine), seen | mine
        cells = F.array(*[F.struct(F.lit(k).alias("column_key"), F.lit(c).alias("source_column")) for k, c in pairs])
        part = rows.select(F.col("out").alias("row_id"), F.col("source").alias("source_row"), F.inline(cells)).select("row_id", "column_key", F.lit(p.source.table_id).alias("source_table"), "source_row", "source_column")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no column comes from a source")
    return out.distinct() if again else out
