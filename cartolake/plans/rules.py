"""Cascading style rules: of the rules that apply, the one of highest priority sets each property."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.functions.expressions import Context, compile_expression
from cartolake.functions.values import BOOLEAN

#: Kinds of rule values and their SQL types.
KINDS = {"color": "string", "number": "double", "text": "string", "bool": "boolean"}


@dataclass
class Rule:
    name: str
    priority: int = 0
    filter: Any = None
    min_zoom: float | None = None
    max_zoom: float | None = None
    values: dict[str, tuple[str, Any]] = field(default_factory=dict)

    def with_priority(self, priority: int) -> Rule:
        self.priority = priority
        return self

    def where(self, expression: Any) -> Rule:
        self.filter = expression
        return self

    def zooms(self, low: float | None = None, high: float | None = None) -> Rule:
        self.min_zoom, self.max_zoom = low, high
        return self

    def _set(self, kind: str, key: str, value: Any) -> Rule:
        self.values[key] = (kind, value)
        return self

    def color(self, key: str, value: str) -> Rule:
        return self._set("color", key, value)

    def number(self, key: str, value: float) -> Rule:
        return self._set("number", key, float(value))

    def text(self, key: str, value: str) -> Rule:
        return self._set("text", key, value)

    def boolean(self, key: str, value: bool) -> Rule:
        return self._set("bool", key, value)

    def applies(self, context: Context) -> Column:
        """Zoom within both ends, and the filter exactly true: a number or text isn't enough."""
        out = F.lit(True)
        if self.min_zoom is not None:
            out = out & (context.zoom >= self.min_zoom)
        if self.max_zoom is not None:
            out = out & (context.zoom <= self.max_zoom)
        if self.filter is not None:
            value = compile_expression(self.filter, context)
            out = out & (F.coalesce(value.column, F.lit(False)) if value is not None and value.kind == BOOLEAN else F.lit(False))
        return out


def cascade(df: DataFrame, rules: list[Rule], zoom: float | Column = 0.0) -> DataFrame:
    """df with a column for each (property, kind) that a rule sets, and sources: the rule that set each property.

    Rules of one priority keep their order; the last that applies wins. A property that rules set
    with several kinds gets a column for each, of which the winner's alone is set.
    """
    context = Context.of(df, zoom)
    order = sorted(rules, key=lambda r: r.priority)
    keys = dict.fromkeys(k for r in order for k in r.values)
    kinds = {k: list(dict.fromkeys(r.values[k][0] for r in order if k in r.values)) for k in keys}
    columns: dict[str, Column] = {}
    winners = []
    for key in keys:
        having = [r for r in reversed(order) if key in r.values]
        for kind in kinds[key]:
            chain = None
            for r in having:
                value = F.lit(r.values[key][1]).cast(KINDS[kind]) if r.values[key][0] == kind else F.lit(None).cast(KINDS[kind])
                chain = F.when(r.applies(context), value) if chain is None else chain.when(r.applies(context), value)
            columns[key if len(kinds[key]) == 1 else f"{key}_{kind}"] = chain
        chain = None
        for r in having:
            chain = F.when(r.applies(context), r.name) if chain is None else chain.when(r.applies(context), r.name)
        winners.append(F.struct(F.lit(key).alias("key"), chain.alias("value")))
    sources = F.map_from_entries(F.filter(F.array(*winners), lambda w: w["value"].isNotNull())) if winners else F.create_map().cast("map<string,string>")
    return df.withColumns(columns | {"sources": sources})
