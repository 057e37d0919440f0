"""JSON expressions of the style language as Spark columns.

compile_expression turns nested JSON arrays into one Column with a kind known in advance, so a
style is a projection that Catalyst optimises and whole-stage codegen runs. An expression with
an unknown operator, or a part that can't be compiled, compiles to None as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.functions.easing import cubic_bezier, exponential
from cartolake.functions.values import ARRAY, BOOLEAN, COLOR, NULL, NUMBER, SQL_TYPES, STRING, Value, color, color_literal, kind_of, number_or, parse_color, text, to_number, truthy

Function = Callable[[list[Value]], Value]


@dataclass
class Context:
    """What an expression can see: property columns by name, zoom, geometry type and user functions."""

    properties: Mapping[str, Value]
    zoom: Column = field(default_factory=lambda: F.lit(0.0))
    geometry_type: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    functions: Mapping[str, Function] = field(default_factory=dict)
    fid: Column | None = None

    @classmethod
    def of(cls, df: DataFrame, zoom: float | Column = 0.0, functions: Mapping[str, Function] | None = None, fid: Column | None = None) -> Context:
        found = {f.name: Value(kind, F.col(f"`{f.name}`").cast(SQL_TYPES[kind])) for f in df.schema if (kind := kind_of(f.dataType))}
        shape = F.col("geometry_type") if "geometry_type" in df.columns else F.lit(None).cast("string")
        return cls(found, zoom if isinstance(zoom, Column) else F.lit(float(zoom)), shape, functions or {}, fid)


class _Refused(Exception):
    pass


def literal(x: Any) -> Value:
    """A JSON scalar; texts that are colours become colours."""
    if x is None:
        return Value(NULL, F.lit(None).cast("string"))
    if isinstance(x, bool):
        return Value(BOOLEAN, F.lit(x))
    if isinstance(x, int | float):
        return Value(NUMBER, F.lit(float(x)))
    if isinstance(x, str):
        parts = color_literal(x)
        return Value(COLOR, color(*parts)) if parts else Value(STRING, F.lit(x))
    raise _Refused


def unify(values: list[Value]) -> tuple[str, list[Column]]:
    """Branches as one kind. Branches of other kinds than the first are null in typed columns."""
    kinds = [v.kind for v in values if v.kind != NULL]
    kind = kinds[0] if kinds else NULL
    if kind == ARRAY:
        return kind, [v.column if v.kind == ARRAY else F.lit(None) for v in values]
    return kind, [v.column if v.kind == kind else F.lit(None).cast(SQL_TYPES[kind]) for v in values]


def equal(a: Value, b: Value) -> Column:
    """Total and strict: Null equals Null, kinds must agree, NaN equals nothing."""
    if NULL in (a.kind, b.kind):
        return a.column.isNull() & b.column.isNull()
    if a.kind != b.kind:
        return a.column.isNull() & b.column.isNull()
    same = a.column.eqNullSafe(b.column)
    return same & ~F.coalesce(F.isnan(a.column), F.lit(False)) if a.kind == NUMBER else same


def _ordered(a: Value, b: Value, op: Callable[[Column, Column], Column]) -> Value:
    if a.kind != b.kind or a.kind not in (NUMBER, STRING):
        return Value(BOOLEAN, F.lit(False))
    good = op(a.column, b.column)
    if a.kind == NUMBER:
        good = good & ~F.isnan(a.column) & ~F.isnan(b.column)
    return Value(BOOLEAN, F.coalesce(good, F.lit(False)))


def _number(c: Column) -> Value:
    return Value(NUMBER, c)


def _divide(a: Value, b: Value, op: Callable[[Column, Column], Column]) -> Value:
    x, y = number_or(a, 0.0), number_or(b, 1.0)
    return _number(F.when(y == 0, 0.0).otherwise(op(x, F.when(y == 0, 1.0).otherwise(y))))


def _extreme(values: list[Value], pick: Callable[..., Column], start: float) -> Value:
    start_col = F.lit(start)
    parts = [F.coalesce(F.nanvl(v.column, start_col), start_col) for v in values if v.kind == NUMBER]
    return _number(pick(start_col, *parts) if parts else start_col)


def _round(x: Column) -> Column:
    return F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5)).cast("double")


def interpolate(kind: list[Any], x: Column, stops: list[tuple[float, Value]]) -> Value:
    """Between stops numbers and colours are blended, other values keep the lower stop; outside, the end stops hold."""
    out_kind, columns = unify([v for _, v in stops])
    at = [s for s, _ in stops]
    branches = [(x <= at[0], columns[0]), (x >= at[-1], columns[-1])]
    for (s0, s1), (c0, c1) in zip(zip(at, at[1:], strict=False), zip(columns, columns[1:], strict=False), strict=True):
        if s1 <= s0:
            continue
        t = _eased(kind, (x - s0) / (s1 - s0))
        if out_kind == NUMBER:
            value = c0 + (c1 - c0) * t
        elif out_kind == COLOR:
            value = color(*[_round(c0[p] + (c1[p] - c0[p]) * t) for p in "rgba"])
        else:
            value = c0
        branches.append(((x >= s0) & (x < s1), value))
    chain = F.when(*branches[0])
    for condition, value in branches[1:]:
        chain = chain.when(condition, value)
    return Value(out_kind, chain)


def _eased(kind: list[Any], t: Column) -> Column:
    name, *args = kind
    if name == "linear":
        return t
    if name == "exponential" and len(args) == 1:
        return exponential(t, float(args[0]))
    if name == "cubic-bezier" and len(args) == 4:
        return cubic_bezier(t, *map(float, args))
    raise _Refused


def step(x: Column, default: Value, stops: list[tuple[float, Value]]) -> Value:
    """The last stop not above x, scanned until one is larger; the default below the first."""
    kind, columns = unify([default, *[v for _, v in stops]])
    chain = None
    for i, (s, _) in enumerate(stops):
        chain = F.when(x < s, columns[i]) if chain is None else chain.when(x < s, columns[i])
    return Value(kind, columns[0] if chain is None else chain.otherwise(columns[-1]))


def _case(parts: list[Value]) -> Value:
    conditions, results = parts[:-1:2], [*parts[1:-1:2], parts[-1]]
    kind, columns = unify(results)
    chain = None
    for c, column in zip(conditions, columns, strict=False):
        chain = F.when(truthy(c), column) if chain is None else chain.when(truthy(c), column)
    return Value(kind, columns[-1] if chain is None else chain.otherwise(columns[-1]))


def _match(x: Value, labels: list[Any], results: list[Value]) -> Value:
    kind, columns = unify(results)
    chain = None
    for label, column in zip(labels, columns, strict=False):
        if isinstance(label, list | dict):
            raise _Refused
        value = Value(STRING, F.lit(label)) if isinstance(label, str) else literal(label)
        hit = equal(x, value)
        chain = F.when(hit, column) if chain is None else chain.when(hit, column)
    return Value(kind, columns[-1] if chain is None else chain.otherwise(columns[-1]))


def _array(items: list[Any]) -> Value:
    scalars = [literal(x) if not isinstance(x, list | dict) else literal(None) for x in items]
    return Value(ARRAY, F.array(*[F.struct(F.lit(v.kind).alias("kind"), text(v).alias("text")) for v in scalars]) if scalars else F.array())


_UNARY: dict[str, Callable[[Value], Value]] = {
    "!": lambda a: Value(BOOLEAN, ~truthy(a)),
    "abs": lambda a: _number(F.abs(number_or(a, 0.0))),
    "floor": lambda a: _number(F.floor(number_or(a, 0.0)).cast("double")),
    "ceil": lambda a: _number(F.ceil(number_or(a, 0.0)).cast("double")),
    "round": lambda a: _number(_round(number_or(a, 0.0))),
    "upcase": lambda a: Value(STRING, F.upper(text(a))),
    "downcase": lambda a: Value(STRING, F.lower(text(a))),
    "to-number": lambda a: _number(to_number(a)),
    "to-string": lambda a: Value(STRING, text(a)),
    "to-boolean": lambda a: Value(BOOLEAN, truthy(a)),
    "to-color": lambda a: a if a.kind == COLOR else Value(COLOR, parse_color(a.column) if a.kind == STRING else F.lit(None).cast(SQL_TYPES[COLOR])),
}
for _alias, _name in (("number", "to-number"), ("string", "to-string"), ("boolean", "to-boolean"), ("to-rgba", "to-color")):
    _UNARY[_alias] = _UNARY[_name]

_BINARY: dict[str, Callable[[Value, Value], Value]] = {
    "==": lambda a, b: Value(BOOLEAN, equal(a, b)),
    "!=": lambda a, b: Value(BOOLEAN, ~equal(a, b)),
    ">": lambda a, b: _ordered(a, b, Column.__gt__),
    ">=": lambda a, b: _ordered(a, b, Column.__ge__),
    "<": lambda a, b: _ordered(a, b, Column.__lt__),
    "<=": lambda a, b: _ordered(a, b, Column.__le__),
    "-": lambda a, b: _number(number_or(a, 0.0) - number_or(b, 0.0)),
    "/": lambda a, b: _divide(a, b, Column.__truediv__),
    "%": lambda a, b: _divide(a, b, Column.__mod__),
}

_MANY: dict[str, Callable[[list[Value]], Value]] = {
    "all": lambda v: Value(BOOLEAN, reduce(Column.__and__, map(truthy, v), F.lit(True))),
    "any": lambda v: Value(BOOLEAN, reduce(Column.__or__, map(truthy, v), F.lit(False))),
    "+": lambda v: _number(reduce(Column.__add__, [number_or(x, 0.0) for x in v], F.lit(0.0))),
    "*": lambda v: _number(reduce(Column.__mul__, [number_or(x, 1.0) for x in v], F.lit(1.0))),
    "min": lambda v: _extreme(v, F.least, float("inf")),
    "max": lambda v: _extreme(v, F.greatest, float("-inf")),
    "concat": lambda v: Value(STRING, F.concat(F.lit(""), *map(text, v))),
    "coalesce": lambda v: Value((u := unify(v))[0], F.coalesce(*u[1])) if v else literal(None),
}


def _stops(rest: list[Any], context: Context) -> list[tuple[float, Value]]:
    out = []
    for at, value in zip(rest[::2], rest[1::2], strict=False):
        if isinstance(at, bool) or not isinstance(at, int | float):
            raise _Refused
        out.append((float(at), _compile(value, context)))
    return out


def _compile(x: Any, context: Context) -> Value:
    if not isinstance(x, list):
        if isinstance(x, dict):
            raise _Refused
        return literal(x)
    if not x or not isinstance(x[0], str):
        raise _Refused
    op, *args = x
    parts = lambda: [_compile(a, context) for a in args]
    if op in ("get", "has"):
        if not args or not isinstance(args[0], str):
            raise _Refused
        found = context.properties.get(args[0])
        if op == "has":
            return Value(BOOLEAN, found.column.isNotNull() if found else F.lit(False))
        return found or literal(None)
    if op == "geometry-type":
        return Value(STRING, context.geometry_type)
    if op == "id":
        return literal(None) if context.fid is None else _number(context.fid.cast("double"))
    if op == "zoom":
        return _number(context.zoom.cast("double"))
    if op == "literal" and args:
        return _array(args[0]) if isinstance(args[0], list) else _compile(args[0], context)
    if op in _UNARY and args:
        return _UNARY[op](_compile(args[0], context))
    if op in _BINARY and len(args) >= 2:
        return _BINARY[op](_compile(args[0], context), _compile(args[1], context))
    if op in _MANY:
        return _MANY[op](parts())
    if op == "case" and len(args) >= 3:
        return _case(parts())
    if op == "match" and len(args) >= 4:
        body = args[1:-1]
        n = len(body) // 2
        return _match(_compile(args[0], context), body[: 2 * n : 2], [*[_compile(r, context) for r in body[1 : 2 * n : 2]], _compile(args[-1], context)])
    if op == "interpolate" and len(args) >= 5 and isinstance(args[0], list) and args[0]:
        return interpolate(args[0], number_or(_compile(args[1], context), 0.0), _stops(args[2:], context))
    if op == "step" and len(args) >= 3:
        return step(number_or(_compile(args[0], context), 0.0), _compile(args[1], context), _stops(args[2:], context))
    if op == "fn" and args and isinstance(args[0], str):
        function = context.functions.get(args[0])
        return function([_compile(a, context) for a in args[1:]]) if function else literal(None)
    raise _Refused


def compile_expression(x: Any, context: Context) -> Value | None:
    """The column of a JSON expression, or None if any part of it can't be compiled."""
    try:
        return _compile(x, context)
    except _Refused:
        return None
