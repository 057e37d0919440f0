"""Attribute and box filters as boolean columns that are never null."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.functions.values import BOOLEAN, NUMBER, STRING, kind_of

_KINDS = {bool: BOOLEAN, int: NUMBER, float: NUMBER, str: STRING}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


class FilterBuilder:
    """Filters over the columns of a DataFrame; kinds must agree for equality, as texts never equal numbers.

    strict also tells whole numbers from fractional ones, by the column's type.
    """

    def __init__(self, df: DataFrame, strict: bool = False) -> None:
        self.types = {f.name: f.dataType for f in df.schema}
        self.strict = strict

    def _column(self, name: str, kind: str) -> Column | None:
        return F.col(f"`{name}`") if name in self.types and kind_of(self.types[name]) == kind else None

    def equal(self, name: str, value: Any) -> Column:
        if value is None:
            return F.col(f"`{name}`").isNull() if name in self.types else F.lit(False)
        column = self._column(name, _KINDS[type(value)])
        if column is None:
            return F.lit(False)
        whole = self.types[name].typeName() in ("byte", "short", "integer", "long")
        if self.strict and _KINDS[type(value)] == NUMBER and whole != isinstance(value, int):
            return F.lit(False)
        return _sure(column == F.lit(value))

    def not_equal(self, name: str, value: Any) -> Column:
        """True for a missing property too."""
        return ~self.equal(name, value)

    def less(self, name: str, value: float) -> Column:
        column = self._column(name, NUMBER)
        return F.lit(False) if column is None else _sure(column < value)

    def greater(self, name: str, value: float) -> Column:
        column = self._column(name, NUMBER)
        return F.lit(False) if column is None else _sure((column > value) & ~F.isnan(column.cast("double")))

    def between(self, name: str, lower: float, upper: float) -> Column:
        column = self._column(name, NUMBER)
        return F.lit(False) if column is None else _sure(column.between(lower, upper))

    def like(self, name: str, pattern: str, compat: bool = False) -> Column:
        """SQL LIKE. compat: a pattern with % is a search for its parts in order, anchored at the start only; without %, _ and . stand for any character."""
        column = self._column(name, STRING)
        if column is None:
            return F.lit(False)
        if not compat:
            return _sure(column.like(pattern))
        if "%" not in pattern:
            any_char = "".join("." if c in "_." else _quoted(c) for c in pattern)
            return _sure(column.rlike(f"(?s)\\A{any_char}\\z"))
        parts = [_quoted(p.replace("_", ".")) for p in pattern.split("%")]
        return _sure(column.rlike("(?s)\\A" + ".*?".join(parts)))

    def bbox(self, min_x: float, min_y: float, max_x: float, max_y: float, columns: tuple[str, str, str, str] = ("min_x", "min_y", "max_x", "max_y")) -> Column:
        """The envelope meets the box, edges included: four comparisons that reach the Parquet scan."""
        a, b, c, d = (F.col(x) for x in columns)
        return _sure((a <= max_x) & (c >= min_x) & (b <= max_y) & (d >= min_y))

    def point_in(self, min_x: float, min_y: float, max_x: float, max_y: float, x: str = "x", y: str = "y") -> Column:
        return _sure(F.col(x).between(min_x, max_x) & F.col(y).between(min_y, max_y))

    def compile(self, tree: dict[str, Any]) -> Column:
        """A filter from nested dicts: {"op": ..., ...}."""
        op = tree["op"]
        if op in ("and", "or"):
            parts = [self.compile(t) for t in tree["filters"]]
            return reduce(Column.__and__, parts, F.lit(True)) if op == "and" else reduce(Column.__or__, parts, F.lit(False))
        if op == "not":
            return ~self.compile(tree["filter"])
        if op == "bbox":
            return self.bbox(*tree["box"])
        if op == "between":
            return self.between(tree["property"], tree["lower"], tree["upper"])
        by_value = {"eq": self.equal, "neq": self.not_equal, "lt": self.less, "gt": self.greater}
        if op in by_value:
            return by_value[op](tree["property"], tree["value"])
        if op == "like":
            return self.like(tree["property"], tree["pattern"], tree.get("compat", False))
        raise ValueError(f"unknown filter {op}")


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in s)
