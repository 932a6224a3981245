"""Exact decimals held as text.

A number is a sign, digits and a point, without an exponent. Numbers of up to 18 digits before and 12 after
the point are worked with as DECIMAL(38,12), beside how many digits stand after the point, so that results
are written with as many digits as exact arithmetic gives. What doesn't fit is never rounded: expressions
hand such rows to `exact`, `sums` adds them in limbs of 18 digits, and comparisons go by a text that sorts as
the numbers do.
"""

from __future__ import annotations

from decimal import Context, Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 12
WIDE = f"decimal(38,{SCALE})"
#: What a number looks like, how long it may be, and how many digits it may have before the point.
CANONICAL = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$"
LONGEST, LARGEST = 256, 101
#: Numbers that the native tier holds.
HELD = rf"^[+-]?0*(?:[0-9]{{1,18}}(?:\.[0-9]{{0,{SCALE}}})?|\.[0-9]{{1,{SCALE}}})$"

#: Why a cell is no usable number.
MISSING, NOT_DECIMAL, TOO_LONG = "missing_value", "not_a_decimal", "number_too_long"


def is_canonical(c: Column) -> Column:
    return (F.length(c) <= LONGEST) & c.rlike(CANONICAL)


def is_held(c: Column) -> Column:
    return c.rlike(HELD)


def number(c: Column) -> Column:
    """The text as a DECIMAL, or null if that doesn't hold it."""
    return F.when(is_held(c), c.cast(WIDE))


def error(c: Column) -> Column:
    """Why c is no number, or null. A number may have LARGEST digits before the point, and its first digit not later than that after it."""
    before, after = _before_point(c), _after_point(c)
    late = (before == "") & (F.length(after) >= LARGEST) & (F.length(F.regexp_replace(after, f"^0{{{LARGEST - 1}}}", "")) < F.length(after))
    usual = is_held(c) & (F.length(c) <= LONGEST)  # told by one pattern; the others are only tried on what it leaves
    return F.when(usual, None).when(c.isNull(), MISSING).when(~is_canonical(c), NOT_DECIMAL).when(~is_held(c) & ((F.length(before) > LARGEST) | late), TOO_LONG)


def digits_after_point(c: Column) -> Column:
    at = F.instr(c, ".")
    return F.when(at > 0, F.length(c) - at).otherwise(0)


def _before_point(c: Column) -> Column:
    """Digits before the point without needless zeros; empty for none."""
    return F.regexp_replace(F.substring_index(c, ".", 1), r"^[+-]?0*", "")


def _after_point(c: Column) -> Column:
    return F.when(F.instr(c, ".") > 0, F.substring_index(c, ".", -1)).otherwise("")


def order_key(c: Column) -> Column:
    """A text for each number that sorts as the numbers do; the same for numbers that are equal."""
    plain = F.concat(F.lit("1"), F.lpad(F.length(c).cast("string"), 3, "0"), c, F.lit("."))  # a whole number that begins with no sign or zero is its own digits
    whole, rest = _before_point(c), F.rtrim(F.translate(_after_point(c), "0", " "))
    size = F.concat(F.lpad(F.length(whole).cast("string"), 3, "0"), whole, F.lit("."), F.translate(rest, " ", "0"))
    minus = c.startswith("-") & ((whole != "") | (rest != ""))
    return F.when(c.rlike(r"^[1-9][0-9]{0,100}\z"), plain).when(minus, F.concat(F.lit("0"), F.translate(size, "0123456789", "9876543210"), F.lit("~"))).otherwise(F.concat(F.lit("1"), size))


def written(value: Column, digits: Column, scale: int = SCALE) -> Column:
    """value, a DECIMAL of that scale, as text with digits after the point."""
    text = value.cast("string")
    return F.when(digits <= 0, F.substring_index(text, ".", 1)).otherwise(F.substr(text, F.lit(1), F.length(text) - (F.lit(scale) - digits)))


def narrowed(value: Column, precision: int, scale: int) -> Column:
    """value where the smaller DECIMAL holds it exactly, else null."""
    small = value.try_cast(f"decimal({precision},{scale})")
    return F.when(small == value, small)


def tenth(places: int) -> Column:
    """10 ** -places as a DECIMAL with no digit before its point, so that 25 digits times it fit in 38."""
    return F.lit(format(Decimal(1).scaleb(-places), "f")).cast(f"decimal({max(places, 1)},{places})")


EXACT = Context(prec=2 * LONGEST)


def _apart(pairs: pa.Array) -> pa.Array:
    out = []
    for s in pairs.to_pylist():
        out.append(None if s is None else format(EXACT.subtract(*map(Decimal, s.split("|"))), "f"))
    return pa.array(out, pa.string())


def difference(a: Column, b: Column) -> Column:
    """a - b as text, exactly; null where one is."""
    x, y = number(a), number(b)
    native = written(F.try_subtract(x.cast("decimal(37,12)"), y.cast("decimal(37,12)")).cast(WIDE), F.greatest(digits_after_point(a), digits_after_point(b)))
    far = a.isNotNull() & b.isNotNull() & (x.isNull() | y.isNull())
    return F.coalesce(F.arrow_udf(_apart, "string")(F.when(far, F.concat_ws("|", a, b))), native)


def within(difference: Column, tolerance: Column) -> Column:
    """Whether a difference is at most tolerance in size, both texts."""
    return order_key(F.regexp_replace(difference, r"^[+-]", "")) <= order_key(tolerance)


def canonical_text(value, negative: bool = True) -> str:
    """A number of a configuration as text; ValueError if it is none."""
    import re

    text = str(value)
    if isinstance(value, (bool, float)) or len(text) > LONGEST or not re.match(CANONICAL, text) or (not negative and Decimal(text) < 0):
        raise ValueError(f"no {'' if negative else 'positive '}decimal: {value!r}")
    return text


def localized(c: Column, decimal: str = ".", thousands: str | None = None) -> Column:
    """Text with declared separators as a canonical decimal, or null: groups have three digits, and none stands after the point."""
    text = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    d = "\\" + decimal
    whole = r"[0-9]*" if thousands is None else rf"(?:[0-9]{{1,3}}(?:\Q{thousands}\E[0-9]{{3}})+|[0-9]*)"
    fine = text.rlike(rf"^[+-]?{whole}(?:{d}[0-9]*)?$") & text.rlike("[0-9]")
    plain = F.replace(text, F.lit(thousands), F.lit("")) if thousands else text
    plain = F.replace(plain, F.lit(","), F.lit(".")) if decimal == "," else plain
    return F.when(fine, canonical(plain))


def canonical(c: Column) -> Column:
    """A canonical decimal as it is written out: no plus, no needless zeros before the point, no bare point."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^[+-]", ""), r"\.$", "")
    bare = F.regexp_replace(F.when(bare.startswith("."), F.concat(F.lit("0"), bare)).otherwise(bare), r"^0+(?=[0-9])", "")
    return F.concat(F.when(c.startswith("-"), F.lit("-")).otherwise(F.lit("")), bare)
