"""Styled layer descriptors as cascading rules, and back."""

from __future__ import annotations

import math
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolake.plans.rules import Rule

#: Fixed value: the scale denominator at zoom 0.
SCALE_0 = 559082264.0


def scale_to_zoom(scale: float) -> float:
    return math.log2(SCALE_0 / scale) if scale > 0 else 0.0


def zoom_of_scale(scale: Column) -> Column:
    return F.when(scale > 0, F.log2(F.lit(SCALE_0) / scale)).otherwise(0.0)


def zoom_to_scale(zoom: float) -> float:
    return SCALE_0 / 2**zoom


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in e.iter() if _name(x) == name]


def _text(e: ET.Element, name: str) -> str | None:
    found = _all(e, name)
    return (found[0].text or "").strip() if found else None


def _parameter(e: ET.Element, name: str) -> str | None:
    for x in e.iter():
        if _name(x) in ("SvgParameter", "CssParameter") and x.get("name") == name:
            return (x.text or "").strip()
    return None


def sld_filter(e: ET.Element) -> list | None:
    """A filter element as an expression; children that can't be read are dropped, And and Or of one are it."""
    name = _name(e)
    if name in ("And", "Or"):
        parts = [f for f in map(sld_filter, e) if f]
        return parts[0] if len(parts) == 1 else ["all" if name == "And" else "any", *parts] if parts else None
    if name == "Not":
        inner = next((f for f in map(sld_filter, e) if f), None)
        return ["!", inner] if inner else None
    prop, value = _text(e, "PropertyName") or _text(e, "ValueReference"), _text(e, "Literal")
    if prop is None or value is None:
        return None
    if name == "PropertyIsEqualTo":
        return ["==", ["to-string", ["get", prop]], ["concat", value]]
    ops = {"PropertyIsGreaterThan": ">", "PropertyIsLessThan": "<"}
    try:
        return [ops[name], ["get", prop], float(value)] if name in ops else None
    except ValueError:
        return None


def parse_sld(xml: str) -> list[Rule]:
    """Rules in document order, which is their priority. Namespaces and prefixes are no matter.

    Lines have stroke and width 1, polygons a fill #cccccc of opacity 1 and a black outline of 1
    unless they say otherwise; a largest scale is the least zoom.
    """
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        raise ValueError(f"not an SLD document: {e}") from e
    rules = []
    for i, x in enumerate(_all(root, "Rule")):
        r = Rule(_text(x, "Name") or f"rule-{i}", i)
        largest, least = _text(x, "MaxScaleDenominator"), _text(x, "MinScaleDenominator")
        r.zooms(scale_to_zoom(float(largest)) if largest else None, scale_to_zoom(float(least)) if least else None)
        filters = [c for f in _all(x, "Filter") for c in f]
        r.filter = sld_filter(filters[0]) if filters else None
        for s in _all(x, "LineSymbolizer"):
            r.color("line-color", _parameter(s, "stroke") or "#000000").number("line-width", float(_parameter(s, "stroke-width") or 1))
        for s in _all(x, "PolygonSymbolizer"):
            fill = next(iter(_all(s, "Fill")), s)
            r.color("fill-color", _parameter(fill, "fill") or "#cccccc").number("fill-opacity", float(_parameter(fill, "fill-opacity") or 1))
            r.color("outline-color", "#000000").number("outline-width", 1)
        rules.append(r)
    return rules


def to_sld(rules: list[Rule], layer_name: str) -> str:
    """Line and fill rules as a document; texts are escaped."""
    parameter = lambda k, v: f'<se:SvgParameter name="{k}">{escape(str(v))}</se:SvgParameter>'
    body = []
    for r in rules:
        v = {k: x for k, (_, x) in r.values.items()}
        scale = f"<se:MaxScaleDenominator>{zoom_to_scale(r.min_zoom):g}</se:MaxScaleDenominator>" if r.min_zoom is not None else ""
        line = f"<se:LineSymbolizer><se:Stroke>{parameter('stroke', v['line-color'])}{parameter('stroke-width', v.get('line-width', 1))}</se:Stroke></se:LineSymbolizer>" if "line-color" in v else ""
        fill = f"<se:PolygonSymbolizer><se:Fill>{parameter('fill', v['fill-color'])}{parameter('fill-opacity', v.get('fill-opacity', 1))}</se:Fill></se:PolygonSymbolizer>" if "fill-color" in v else ""
        body.append(f"<se:Rule><se:Name>{escape(r.name)}</se:Name>{scale}{line}{fill}</se:Rule>")
    space = 'xmlns="http://www.opengis.net/sld" xmlns:se="http://www.opengis.net/se" version="1.1.0"'
    return f"<StyledLayerDescriptor {space}><NamedLayer><se:Name>{escape(layer_name)}</se:Name><UserStyle><se:FeatureTypeStyle>{''.join(body)}</se:FeatureTypeStyle></UserStyle></NamedLayer></StyledLayerDescriptor>"
