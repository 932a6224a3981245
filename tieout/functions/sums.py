"""Exact sums of numbers of any length, by groups, in one pass.

Numbers that DECIMAL holds are summed as two DECIMALs, before and after the point. A longer number becomes a
row for each limb of 18 digits that isn't zero; limbs are summed by group and place, and carried once for each
group at the end. Rows without a longer number pass through as they are.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decimals as d

#: Digits of a limb.
LIMB = 18
#: Fixed value: digits that a sum may have.
DIGITS = 256
SUM = "decimal(38,0)"
HELD = f"decimal(30,{d.SCALE})"


def _digits(c: Column) -> Column:
    """The digits of c that limbs are cut from, filled up to whole limbs on both sides of the point, which stays."""
    full = lambda text: (F.ceil(F.length(text) / LIMB) * LIMB).cast("int")
    before, after = d._before_point(c), d._after_point(c)
    return F.concat(F.lpad(before, full(before), F.lit("0")), F.lit("."), F.rpad(after, full(after), F.lit("0")))


def _limbs(c: Column, text: Column, before: Column, number: int) -> Column:
    """(number, place, limb) of the limbs of c that aren't zero; place 0 stands just before the point. text are its digits, before how many limbs it has before the point: columns of their own, as a limb after the other reads them."""
    sign = F.when(c.startswith("-"), -1).otherwise(1)
    all_of = F.floor(F.length(text) / LIMB).cast("int")
    # limb k of text begins after the point from k = before on
    limb = lambda k: F.struct(F.lit(number).alias("number"), (before - 1 - k).alias("place"), (F.substr(text, F.when(k < before, 1).otherwise(2) + k * LIMB, F.lit(LIMB)).cast("long") * sign).alias("limb"))
    some = F.when(all_of > 0, F.sequence(F.lit(0), all_of - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(some, limb), lambda s: s["limb"] != 0)


def _carried(sums: pa.Array) -> pa.Array:
    """Texts 'digits|whole|rest|place:limb place:limb ...' -> the exact sum, null if it has too many digits."""
    out = []
    for s in sums.to_pylist():
        if s is None:
            out.append(None)
            continue
        digits, whole, rest, limbs = s.split("|")
        total = d.EXACT.add(Decimal(whole or 0), Decimal(rest or 0))
        for x in limbs.split():
            place, limb = x.split(":")
            total = d.EXACT.add(total, Decimal(limb).scaleb(LIMB * int(place), d.EXACT))
        total = total.quantize(Decimal(1).scaleb(-int(digits)), context=d.EXACT)
        out.append(format(total, "f") if len(total.as_tuple().digits) <= DIGITS else None)
    return pa.array(out, pa.string())


def grouped_sums(df: DataFrame, by: dict[str, Column], cells: dict[str, Column], others: dict[str, Column], fine: dict[str, Column] | None = None) -> DataFrame:
    """by, others and, for each of cells, its exact sum as text ('0' of none; null if it has over DIGITS digits).

    Cells that are no numbers are left out; fine are columns of df that tell it where it is known. others are aggregates of the rows. A group's limbs are one row for
    each place before they meet, whatever the group's size. Without by there is one row, of nulls if df is empty.
    """
    keys, names = [f"_by{i}" for i in range(len(by))], list(cells)
    given, cells = cells, {n: F.col(f"_c{i}") for i, n in enumerate(cells)}
    # columns of their own, so that what is named several times is worked out once a row
    rows = df.withColumns({f"_by{i}": c for i, c in enumerate(by.values())} | {f"_c{i}": c for i, c in enumerate(given.values())})
    rows = rows.withColumns({f"_n{i}": d.number(c).cast(HELD) for i, c in enumerate(cells.values())} | {f"_ok{i}": (fine or {}).get(n, d.error(c).isNull()) for i, (n, c) in enumerate(cells.items())})
    wide = [F.col(f"_n{i}").isNull() & F.col(f"_ok{i}") for i in range(len(cells))]
    rows = rows.withColumns({f"_t{i}": F.when(w, _digits(c)) for i, (w, c) in enumerate(zip(wide, cells.values()))})
    rows = rows.withColumns({f"_b{i}": F.floor((F.instr(f"_t{i}", ".") - 1) / LIMB).cast("int") for i in range(len(cells))})
    some = wide[0]
    for w in wide[1:]:
        some = some | w
    none = F.array(F.lit(None).cast("struct<number:int,place:int,limb:bigint>"))
    limbs = F.concat(none, *[F.when(w, _limbs(c, F.col(f"_t{i}"), F.col(f"_b{i}"), i)).otherwise(F.array().cast("array<struct<number:int,place:int,limb:bigint>>")) for i, (w, c) in enumerate(zip(wide, cells.values()))])
    rows = rows.withColumn("_limb", F.explode_outer(F.when(some, limbs)))  # one row with null for each row of df, and its limbs
    own = []
    for i, c in enumerate(cells.values()):
        number = F.col(f"_n{i}")
        whole = F.floor(number).cast("decimal(19,0)")
        own += [F.sum(whole.cast(SUM)).alias(f"w{i}"), F.sum((number - whole).cast("decimal(38,12)")).alias(f"r{i}"), F.max(F.when(F.col(f"_ok{i}"), d.digits_after_point(c))).alias(f"d{i}")]
    parts = rows.groupBy(*keys, F.col("_limb.number").alias("_number"), F.col("_limb.place").alias("_place")).agg(F.sum(F.col("_limb.limb").cast(SUM)).alias("_sum"), F.struct(*own, *[a.alias(n) for n, a in others.items()]).alias("_own"))
    limb = F.when(F.col("_place").isNotNull(), F.struct(F.col("_number").alias("number"), F.concat_ws(":", "_place", "_sum").alias("text")))
    met = parts.groupBy(*keys).agg(F.first(F.when(F.col("_place").isNull(), F.col("_own")), ignorenulls=True).alias("_own"), F.collect_list(limb).alias("_limbs"))

    def total(i: int) -> Column:
        whole, rest, digits = (F.col(f"_own.{k}{i}") for k in "wrd")
        mine = F.transform(F.filter("_limbs", lambda x: x["number"] == i), lambda x: x["text"])
        native = F.try_add(whole.try_cast("decimal(37,12)"), rest.try_cast("decimal(37,12)")).cast(d.WIDE)
        text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
        far = (F.size(mine) > 0) | (whole.isNotNull() & native.isNull())
        packed = F.concat_ws("|", text(digits), text(whole), text(rest), F.array_join(mine, " "))
        return F.when(far, F.arrow_udf(_carried, "string")(F.when(far, packed))).when(digits.isNull(), "0").otherwise(d.written(F.coalesce(native, F.lit(0).cast(d.WIDE)), digits))

    return met.select(*[F.col(k).alias(n) for k, n in zip(keys, by)], *[F.col(f"_own.{n}").alias(n) for n in others], *[total(i).alias(n) for i, n in enumerate(names)])
