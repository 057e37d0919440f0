"""SVG text: one element for each feature, joined in paint order."""

from __future__ import annotations

from xml.sax.saxutils import escape as _escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(text: Column) -> Column:
    """Text safe in content and attributes."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def css(rgba: Column) -> Column:
    return F.format_string("rgba(%d,%d,%d,%.3f)", rgba["r"], rgba["g"], rgba["b"], rgba["a"] / 255.0)


def circle(x: Column, y: Column, radius: Column, fill: Column) -> Column:
    return F.format_string('<circle cx="%.2f" cy="%.2f" r="%.2f" fill="%s"/>', x, y, radius, fill)


def _points(pts: Column) -> Column:
    return F.array_join(F.transform(pts, lambda p: F.format_string("%.2f,%.2f", p["x"], p["y"])), " ")


def polyline(pts: Column, stroke: Column, width: Column) -> Column:
    return F.format_string('<polyline points="%s" fill="none" stroke="%s" stroke-width="%.2f"/>', _points(pts), stroke, width)


def polygon(rings: Column, fill: Column) -> Column:
    path = F.array_join(F.transform(rings, lambda r: F.concat(F.lit("M"), F.array_join(F.transform(r, lambda p: F.format_string("%.2f %.2f", p["x"], p["y"])), " L"), F.lit(" Z"))), " ")
    return F.format_string('<path d="%s" fill="%s" fill-rule="evenodd"/>', path, fill)


def label(x: Column, y: Column, size: Column, fill: Column, text: Column) -> Column:
    return F.format_string('<text x="%.2f" y="%.2f" font-size="%.2f" fill="%s">%s</text>', x, y, size, fill, escape(text))


#: What ends a document.
TAIL = "\n</svg>"


def head(width: float, height: float, title: str | None = None) -> str:
    """What begins a document."""
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}" viewBox="0 0 {width:g} {height:g}">' + (f"<title>{_escape(title)}</title>" if title else "")


def documents(elements: DataFrame, width: float, height: float, title: str | None = None) -> DataFrame:
    """(canvas, svg) from elements (canvas, layer_ord, fid, element): small documents as values; sources.canvases streams large ones to files."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer_ord", "fid", "element"))), lambda s: s["element"]), "\n")
    return elements.groupBy("canvas").agg(F.concat(F.lit(head(width, height, title) + "\n"), body, F.lit(TAIL)).alias("svg"))


def graticule_interval(span: Column) -> Column:
    """Degrees between lines for a range of degrees."""
    return F.when(span > 90, 30.0).when(span > 45, 15.0).when(span > 20, 10.0).when(span > 10, 5.0).when(span > 2, 1.0).when(span > 1, 0.5).otherwise(0.1)


def nice_round(v: Column) -> Column:
    """1, 2 or 5 times a power of ten, not above v."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    part = v / power
    return F.when(v > 0, F.when(part >= 5, 5.0).when(part >= 2, 2.0).otherwise(1.0) * power).otherwise(0.0)
