"""Tables of exact text: rows with an id and a position, one nullable text column for each key."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW, POS = "_row_id", "_pos"


@dataclass(frozen=True)
class Input:
    """A table that another one was made of: which rows of it went into which (out, source; None: the same ids), and which columns.

    Links name each pair once. gathers says which way they part: a row of it goes into one row at most, as in
    groups; otherwise a row is made of one row of it at most.
    """

    table: Table
    columns: dict[str, tuple[str, ...]]
    links: DataFrame | None = None
    gathers: bool = False


@dataclass(frozen=True)
class Table:
    """df has ROW, POS and the keys, all text but POS. Labels are for people and never looked up."""

    table_id: str
    df: DataFrame
    keys: tuple[str, ...]
    labels: dict[str, str] = field(default_factory=dict)
    title: str = ""
    inputs: tuple[Input, ...] = ()

    def with_df(self, df: DataFrame, keys: tuple[str, ...] | None = None) -> Table:
        """The table with other rows or cells of the same rows."""
        return replace(self, df=df, keys=self.keys if keys is None else keys)

    def made(self, df: DataFrame, keys: tuple[str, ...], columns: dict[str, tuple[str, ...]] | None = None, links: DataFrame | None = None, more: tuple[Input, ...] = (), gathers: bool = False) -> Table:
        """A table made of this one. Columns that aren't named come from those of the same key."""
        own = {k: (columns or {}).get(k, (k,) if k in self.keys else ()) for k in keys}
        return replace(self, df=df, keys=keys, inputs=(Input(self, {k: c for k, c in own.items() if c}, links, gathers), *more))

    def label(self, key: str) -> str:
        return self.labels.get(key, key)


def as_text(c: Column, kind: str, money_scale: int = 2) -> Column:
    """A typed column as text: binary fractions with a fixed scale, dates as ISO."""
    if kind in ("double", "float"):
        return c.cast(f"decimal(18,{money_scale})").cast("string")
    if kind == "timestamp":
        return F.date_format(c, "yyyy-MM-dd")
    return c.cast("string")


def table_of(df: DataFrame, table_id: str, keys: list[str], position: Column | None = None, scales: dict[str, int] | None = None) -> Table:
    """The keys of df as text. Rows are numbered as they are scanned, before any shuffle, unless position numbers them."""
    kinds = dict(df.dtypes)
    pos = (F.monotonically_increasing_id() if position is None else position).cast("long")
    rows = df.select(pos.alias(POS), *[as_text(F.col(k), kinds[k], (scales or {}).get(k, 2)).alias(k) for k in keys])
    return Table(table_id, rows.withColumn(ROW, F.concat(F.lit(f"{table_id}:"), F.col(POS).cast("string"))), tuple(keys), title=table_id)


def row_id(*parts: Column | str) -> Column:
    """A stable id from parts; nulls count as themselves."""
    return F.substring(F.sha2(F.to_json(F.array(*[p if isinstance(p, Column) else F.lit(p) for p in parts])), 256), 1, 24)


def digest(*parts: Column) -> Column:
    """The SHA-256 of the parts in canonical JSON."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)
