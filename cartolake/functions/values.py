"""Values of the style language as Spark columns: kinds, truth, text, numbers, colours.

A Value pairs a Column with its kind, known when the expression is compiled. SQL null stands
for the language's Null whatever the kind.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER, STRING, BOOLEAN, COLOR, ARRAY, NULL = "number", "string", "boolean", "color", "array", "null"
COLOR_TYPE = "struct<r:int,g:int,b:int,a:int>"
SQL_TYPES = {NUMBER: "double", STRING: "string", BOOLEAN: "boolean", COLOR: COLOR_TYPE, NULL: "string"}

#: The named colours of the style language.
NAMED_COLORS = {
    "black": (0, 0, 0),
    "white": (255, 255, 255),
    "red": (255, 0, 0),
    "green": (0, 128, 0),
    "blue": (0, 0, 255),
    "yellow": (255, 255, 0),
    "cyan": (0, 255, 255),
    "magenta": (255, 0, 255),
    "transparent": (0, 0, 0, 0),
}


class Value(NamedTuple):
    kind: str
    column: Column


def kind_of(data_type: T.DataType) -> str | None:
    """The kind of a data column, or None for types the language lacks."""
    if isinstance(data_type, T.NumericType):
        return NUMBER
    if isinstance(data_type, T.StringType):
        return STRING
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    return None


def color(r: Column | int, g: Column | int, b: Column | int, a: Column | int = 255) -> Column:
    part = lambda v, n: (v if isinstance(v, Column) else F.lit(v)).cast("int").alias(n)
    return F.struct(part(r, "r"), part(g, "g"), part(b, "b"), part(a, "a"))


def byte(x: Column) -> Column:
    """A number as 0..255: truncated, held to the range, NaN as 0."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.nanvl(x.cast("double"), F.lit(0.0)))).cast("int")


def number_text(x: Column) -> Column:
    """The shortest decimal without exponent or trailing .0."""
    x = x.cast("double")
    size = F.abs(x)
    trimmed = lambda scale: F.regexp_replace(F.regexp_replace(x.cast(f"decimal(38,{scale})").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return (
        F.when(x.isNull(), None)
        .when(F.isnan(x), "NaN")
        .when(x == float("inf"), "inf")
        .when(x == float("-inf"), "-inf")
        .when((x == F.floor(x)) & (size < 1e15), x.cast("long").cast("string"))
        .when(size >= 1e15, F.format_string("%.0f", x))
        .when(size < 1e-3, F.when(size >= 1e-37, trimmed(37)).otherwise("0"))
        .when(size >= 1e7, trimmed(18))
        .otherwise(x.cast("string"))
    )


def text(v: Value) -> Column:
    """What concat and to-string make of a value; Null is the empty string."""
    if v.kind == STRING:
        return F.coalesce(v.column, F.lit(""))
    if v.kind == NUMBER:
        return F.coalesce(number_text(v.column), F.lit(""))
    if v.kind == BOOLEAN:
        return F.coalesce(v.column.cast("string"), F.lit(""))
    if v.kind == COLOR:
        c = v.column
        parts = F.concat(F.lit("rgba("), F.concat_ws(",", *[c[p].cast("string") for p in "rgba"]), F.lit(")"))
        return F.when(c.isNull(), "").otherwise(parts)
    return F.lit("[array]" if v.kind == ARRAY else "")


def truthy(v: Value) -> Column:
    """False for Null, false, 0, the empty string and the empty array; NaN and colours are true."""
    c = v.column
    if v.kind == BOOLEAN:
        return F.coalesce(c, F.lit(False))
    if v.kind == NUMBER:
        return F.coalesce(c != 0, F.lit(False))
    if v.kind == STRING:
        return F.coalesce(c != "", F.lit(False))
    if v.kind == ARRAY:
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull() if v.kind == COLOR else F.lit(False)


def number_or(v: Value, default: float) -> Column:
    return F.coalesce(v.column, F.lit(default)) if v.kind == NUMBER else F.lit(default)


def to_number(v: Value) -> Column:
    """Numbers stay, booleans are 1 or 0, texts are parsed; all else is 0."""
    if v.kind == NUMBER:
        return number_or(v, 0.0)
    if v.kind == BOOLEAN:
        return F.coalesce(v.column.cast("int").cast("double"), F.lit(0.0))
    if v.kind == STRING:
        s = v.column
        plain = s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
        special = F.lower(F.regexp_replace(s, r"^[+-]", ""))
        sign = F.when(s.startswith("-"), -1.0).otherwise(1.0)
        parsed = F.when(plain, s.try_cast("double")).when(special.isin("inf", "infinity"), sign * float("inf")).when(special == "nan", F.lit(float("nan")))
        return F.coalesce(parsed, F.lit(0.0))
    return F.lit(0.0)


def parse_color(s: Column) -> Column:
    """A CSS colour: a name, #rgb, #rrggbb, #rrggbbaa, rgb() or rgba(); null if it is none."""
    s = F.btrim(s)
    named = F.lower(s)
    out = F.when(F.lit(False), color(0, 0, 0))
    for name, parts in NAMED_COLORS.items():
        out = out.when(named == name, color(*parts))
    pair = lambda at: F.conv(F.substring(s, at, 2), 16, 10)
    single = lambda at: F.conv(F.concat(F.substring(s, at, 1), F.substring(s, at, 1)), 16, 10)
    out = out.when(s.rlike("^#[0-9a-fA-F]{3}$"), color(single(2), single(3), single(4)))
    out = out.when(s.rlike("^#[0-9a-fA-F]{6}$"), color(pair(2), pair(4), pair(6)))
    out = out.when(s.rlike("^#[0-9a-fA-F]{8}$"), color(pair(2), pair(4), pair(6), pair(8)))
    inner = F.split(F.regexp_extract(s, r"^rgba?\((.*)\)$", 1), ",")
    part = lambda i: F.btrim(F.get(inner, F.lit(i))).try_cast("int")
    fits = lambda n: F.forall(F.transform(F.slice(inner, 1, n), lambda x: F.btrim(x).try_cast("int")), lambda x: F.coalesce(x.between(0, 255), F.lit(False)))
    # the fraction is single precision before it is truncated
    alpha = F.btrim(F.get(inner, F.lit(3))).try_cast("float")
    rgb = s.startswith("rgb(") & (F.size(inner) == 3) & fits(3)
    rgba = s.startswith("rgba(") & (F.size(inner) == 4) & fits(3) & alpha.isNotNull()
    return out.when(rgb, color(part(0), part(1), part(2))).when(rgba, color(part(0), part(1), part(2), byte((alpha * F.lit(255.0).cast("float")).cast("double"))))


def color_literal(s: str) -> tuple[int, int, int, int] | None:
    """parse_color for a literal, on the driver."""
    s = s.strip()
    named = NAMED_COLORS.get(s.lower())
    if named:
        return (*named, 255)[:4]
    digits = s[1:]
    if s.startswith("#") and len(digits) in (3, 6, 8) and all(c in "0123456789abcdefABCDEF" for c in digits):
        digits = "".join(c * 2 for c in digits) if len(digits) == 3 else digits
        return tuple(int(x, 16) for x in (digits[0:2], digits[2:4], digits[4:6], digits[6:8] or "ff"))  # type: ignore[return-value]
    for head, n in (("rgba(", 4), ("rgb(", 3)):
        if s.startswith(head) and s.endswith(")"):
            parts = [p.strip() for p in s[len(head) : -1].split(",")]
            try:
                rgb = [int(p) for p in parts[:3]]
                alpha = int(max(0.0, min(255.0, float(parts[3]) * 255))) if n == 4 else 255
            except (ValueError, IndexError):
                return None
            return (*rgb, alpha) if len(parts) == n and all(0 <= v <= 255 for v in rgb) else None  # type: ignore[return-value]
    return None
