"""What recipes may say, as data, and one reader of it for expressions and conditions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

#: How deep objects nest, how many parts a call or joint has, how many values a list.
DEEPEST, PARTS, VALUES = 16, 64, 1000


@dataclass(frozen=True)
class Option:
    default: Any
    allowed: Callable[[Any], bool]


@dataclass(frozen=True)
class Operation:
    least: int
    most: int
    options: dict[str, Option] = field(default_factory=dict)


SCALES = range(13)
_scale = lambda default: {"scale": Option(default, lambda v: type(v) is int and v in SCALES)}
#: The operations of expressions.
OPERATIONS = {
    "add": Operation(2, PARTS),
    "subtract": Operation(2, 2),
    "multiply": Operation(2, PARTS),
    "divide": Operation(2, 2, _scale(12)),
    "round": Operation(1, 1, _scale(2)),
    "concat": Operation(1, PARTS),
    "coalesce": Operation(1, PARTS),
    "trim": Operation(1, 1),
    "upper": Operation(1, 1),
    "lower": Operation(1, 1),
    "decimal": Operation(1, 1, {"decimal_separator": Option(".", lambda v: v in (".", ",")), "thousands_separator": Option(None, lambda v: v in (None, ".", ",", " ", " ", "'"))}),
    "date": Operation(1, 1, {"format": Option(None, lambda v: isinstance(v, str) and v != "")}),
}
#: Comparisons of conditions, and how both sides are read.
COMPARISONS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "in", "is_null")
KINDS = ("text", "decimal")


def constant(value: Any) -> str | None:
    if isinstance(value, (bool, float)) or not isinstance(value, (str, int, Decimal, type(None))):
        raise ValueError(f"no text, whole number or null: {value!r}")
    return format(value, "f") if isinstance(value, Decimal) else None if value is None else str(value)


def _object(value: Any, depth: int) -> dict:
    if not isinstance(value, dict) or depth > DEEPEST:
        raise ValueError(f"an object is wanted, {DEEPEST} deep at most: {value!r}")
    return value


def _parts(value: Any, least: int, most: int) -> list:
    if not isinstance(value, list) or not least <= len(value) <= most:
        raise ValueError(f"{least} to {most} parts are wanted: {value!r}")
    return value


def key(value: Any, keys: tuple[str, ...]) -> str:
    if value not in keys:
        raise ValueError(f"no column {value!r}")
    return value


def expression(value: Any, keys: tuple[str, ...], depth: int = 0) -> tuple:
    """('cell', key), ('const', text or None) or (operation, options, parts); ValueError for anything else."""
    given = _object(value, depth)
    match given:
        case {"column": k, **rest} if not rest:
            return "cell", key(k, keys)
        case {"literal": v, **rest} if not rest:
            return "const", constant(v)
    op = OPERATIONS.get(given.get("op"))
    if op is None:
        raise ValueError(f"no operation {given.get('op')!r}")
    unknown = given.keys() - {"op", "args"} - op.options.keys()
    options = {name: given.get(name, o.default) for name, o in op.options.items()}
    wrong = [name for name, o in op.options.items() if not o.allowed(options[name])]
    if unknown or wrong or len(options) == 2 and len(set(options.values())) == 1:
        raise ValueError(f"wrong options of {given['op']}: {sorted(unknown) or wrong or options}")
    return given["op"], options, tuple(expression(a, keys, depth + 1) for a in _parts(given.get("args"), op.least, op.most))


def cells(tree: tuple) -> list[str]:
    """The keys that an expression or condition reads, in order."""
    found = []
    todo = [tree]
    while todo:
        node = todo.pop(0)
        if node[0] == "cell":
            found.append(node[1])
        elif node[0] == "test":
            found.append(node[1])
        elif node[0] != "const":
            todo = [*node[-1], *todo]
    return list(dict.fromkeys(found))


def condition(value: Any, keys: tuple[str, ...], depth: int = 0) -> tuple:
    """('all' | 'any' | 'not', parts) or ('test', key, comparison, kind, values); ValueError for anything else."""
    given = _object(value, depth)
    joint = next((j for j in ("all", "any", "not") if j in given), None)
    if joint:
        if len(given) > 1:
            raise ValueError(f"{joint} stands alone")
        parts = [given[joint]] if joint == "not" else _parts(given[joint], 1, PARTS)
        return joint, tuple(condition(p, keys, depth + 1) for p in parts)
    column, comparison, kind, asked = key(given.get("column"), keys), given.get("operator"), given.get("type", "text"), given.get("value")
    if comparison not in COMPARISONS or kind not in KINDS:
        raise ValueError(f"no comparison {comparison!r} of {kind!r}")
    listed = _parts(asked, 0, VALUES) if comparison == "in" else [] if comparison == "is_null" else [asked]
    return "test", column, comparison, kind, tuple(map(constant, listed))
