"""The tier for numbers of any length: a parsed expression worked out for one row with Python's decimals."""

from __future__ import annotations

import json
from datetime import datetime
from decimal import ROUND_HALF_EVEN, Context, Decimal, Inexact, InvalidOperation

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import decimals as d

#: Fixed value: digits that a result may have.
PRECISION = 256
KEPT = Context(prec=PRECISION, traps=[Inexact, InvalidOperation])
ROUNDED = Context(prec=PRECISION, rounding=ROUND_HALF_EVEN, traps=[InvalidOperation])


class Fault(Exception):
    """Why there is no value; its text is the fault's code."""


def _plain(text: str) -> Decimal:
    if len(text) > d.LONGEST or any(ch not in "0123456789.+-" for ch in text):
        raise Fault(d.NOT_DECIMAL)
    try:
        value = Decimal(text)
    except InvalidOperation:
        raise Fault(d.NOT_DECIMAL) from None
    if abs(value.adjusted()) >= d.LARGEST:
        raise Fault(d.TOO_LONG)
    return value


def _folded(step):
    def run(values: list[str], options: dict) -> Decimal:
        numbers = [_plain(v) for v in values]
        total = numbers[0]
        for n in numbers[1:]:
            total = step(total, n)
        return total

    return run


def _ratio(values: list[str], options: dict) -> Decimal:
    """Rounded once: by the remainder of the quotient in units of the last digit."""
    over, under = map(_plain, values)
    if not under:
        raise Fault("division_by_zero")
    many, size = over.copy_abs().scaleb(options["scale"], KEPT), under.copy_abs()
    units = KEPT.divide_int(many, size)
    twice = KEPT.multiply(KEPT.subtract(many, KEPT.multiply(units, size)), Decimal(2))
    if twice > size or (twice == size and KEPT.remainder(units, Decimal(2))):
        units = KEPT.add(units, Decimal(1))
    signed = units.copy_negate() if units and over.is_signed() != under.is_signed() else units
    return signed.scaleb(-options["scale"], KEPT)


def _half_even(values: list[str], options: dict) -> Decimal:
    return _plain(values[0]).quantize(Decimal(1).scaleb(-options["scale"]), context=ROUNDED)


def _separated(values: list[str], options: dict) -> Decimal:
    text, point, group = values[0].strip(), options["decimal_separator"], options["thousands_separator"]
    whole, found, rest = text.partition(point)
    if group and group in whole:
        first, *others = whole.lstrip("+-").split(group)
        if not 1 <= len(first) <= 3 or any(len(o) != 3 for o in others):
            raise Fault("wrong_separators")
        whole = whole.replace(group, "")
    try:
        return _plain(whole + ("." + rest if found else ""))
    except Fault:
        raise Fault("wrong_separators") from None


def _day(values: list[str], options: dict) -> str:
    try:
        return datetime.strptime(values[0], options["format"]).date().isoformat()
    except ValueError:
        raise Fault("not_a_date") from None


OPERATIONS = {
    "add": _folded(KEPT.add), "subtract": _folded(KEPT.subtract), "multiply": _folded(KEPT.multiply), "divide": _ratio, "round": _half_even, "decimal": _separated, "date": _day,
    "concat": lambda v, o: "".join(v), "trim": lambda v, o: v[0].strip(), "upper": lambda v, o: v[0].upper(), "lower": lambda v, o: v[0].lower(),
}


def worked_out(tree: tuple, cells: dict[str, str]) -> str | None:
    """The value of ('cell', key), ('const', text) or (operation, options, parts)."""
    kind = tree[0]
    if kind == "cell":
        return cells.get(tree[1])
    if kind == "const":
        return tree[1]
    values = [worked_out(part, cells) for part in tree[2]]
    if kind == "coalesce":
        return next((v for v in values if v is not None), None)
    if None in values:
        raise Fault(d.MISSING)
    try:
        value = OPERATIONS[kind](values, tree[1])
        return value if isinstance(value, str) else format(_plain(format(value, "f")), "f")
    except (Inexact, InvalidOperation):
        raise Fault(d.TOO_LONG) from None


def exact(tree: tuple, keys: list[str], where: Column) -> Column:
    """(value, fault) of the rows with where, in Arrow batches; null for all others."""

    def run(rows: pa.Array) -> pa.Array:
        values, faults = [], []
        for row in rows.to_pylist():
            value = fault = None
            if row is not None:
                try:
                    value = worked_out(tree, json.loads(row))
                except Fault as e:
                    fault = str(e)
            values.append(value)
            faults.append(fault)
        return pa.StructArray.from_arrays([pa.array(values, pa.string()), pa.array(faults, pa.string())], names=["value", "fault"])

    cells = F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys] or [F.lit(0).alias("none")]))
    return F.arrow_udf(run, "value string, fault string")(F.when(where, cells))
