"""drawingInfo documents of feature services as tables of classes, and as style layers.

A renderer is read with a schema, its classes are exploded into rows, and every rule for colours,
sizes and dashes is an expression over them. What can't be carried over is a row of losses. The
layers are put together again as JSON text by one aggregation over a renderer's classes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OUTLINE = "struct<type:string,style:string,color:array<double>,width:double>"
_SYMBOL = f"struct<type:string,style:string,color:array<double>,size:double,width:double,angle:double,height:double,imageData:string,contentType:string,outline:{_OUTLINE}>"
_VALUE = f"struct<value:string,symbol:{_SYMBOL}>"
_BREAK = f"struct<classMinValue:double,classMaxValue:double,symbol:{_SYMBOL}>"
_RENDERER = f"struct<type:string,field:string,field1:string,field2:string,field3:string,fieldDelimiter:string,minValue:double,normalizationType:string,rotationExpression:string,visualVariables:array<string>,symbol:{_SYMBOL},defaultSymbol:{_SYMBOL},uniqueValueInfos:array<{_VALUE}>,classBreakInfos:array<{_BREAK}>>"
_LABEL = "struct<labelExpression:string,labelPlacement:string,where:string,symbol:struct<color:array<double>,haloColor:array<double>,haloSize:double,font:struct<size:double>>>"
SCHEMA = f"struct<transparency:double,renderer:{_RENDERER},labelingInfo:array<{_LABEL}>,showLabels:boolean>"
TRANSPARENT = "rgba(0,0,0,0)"

#: Dash patterns of line styles, in line widths.
DASHES = {
    "esriSLSDash": (4, 3),
    "esriSLSDot": (1, 3),
    "esriSLSDashDot": (4, 3, 1, 3),
    "esriSLSDashDotDot": (4, 3, 1, 3, 1, 3),
    "esriSLSLongDash": (8, 3),
    "esriSLSLongDashDot": (8, 3, 1, 3),
    "esriSLSShortDash": (2, 2),
    "esriSLSShortDot": (1, 2),
    "esriSLSShortDashDot": (2, 2, 1, 2),
    "esriSLSShortDashDotDot": (2, 2, 1, 2, 1, 2),
}
#: Fill styles that become solid, and label placements as anchors.
HATCHES = ("esriSFSBackwardDiagonal", "esriSFSCross", "esriSFSDiagonalCross", "esriSFSForwardDiagonal", "esriSFSHorizontal", "esriSFSVertical")
ANCHORS = {
    "esriServerPointLabelPlacementAboveCenter": "bottom",
    "esriServerPointLabelPlacementAboveLeft": "bottom-right",
    "esriServerPointLabelPlacementAboveRight": "bottom-left",
    "esriServerPointLabelPlacementBelowCenter": "top",
    "esriServerPointLabelPlacementBelowLeft": "top-right",
    "esriServerPointLabelPlacementBelowRight": "top-left",
    "esriServerPointLabelPlacementCenterCenter": "center",
    "esriServerPointLabelPlacementCenterLeft": "right",
    "esriServerPointLabelPlacementCenterRight": "left",
    "esriServerLinePlacementAboveAlong": "bottom",
    "esriServerLinePlacementBelowAlong": "top",
    "esriServerLinePlacementCenterAlong": "center",
}
MARKER_POINTS, LINE_POINTS, PICTURE_POINTS = 8.0, 1.0, 12.0


def pixels(points: Column) -> Column:
    """Points as pixels, with two decimals."""
    return F.round(points * 4.0 / 3.0, 2)


def css_color(c: Column) -> Column:
    """rgba text of a colour array; transparent if it is missing or malformed."""
    n = F.size(c)
    fits = c.isNotNull() & n.between(3, 4) & F.forall(c, lambda x: x.isNotNull())
    channel = lambda i: F.round(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.get(c, F.lit(i))))).cast("int").cast("string")
    alpha = F.format_string("%.3f", F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.coalesce(F.get(c, F.lit(3)), F.lit(255.0)))) / 255.0)
    short = F.regexp_replace(F.regexp_replace(alpha, "0+$", ""), r"\.$", "")
    return F.when(fits, F.concat(F.lit("rgba("), F.concat_ws(",", channel(0), channel(1), channel(2), short), F.lit(")"))).otherwise(TRANSPARENT)


def opacity(info: Column) -> Column:
    """1 less transparency percent, two decimals; null where nothing is see-through."""
    t = F.least(F.lit(100.0), F.greatest(F.lit(0.0), info["transparency"]))
    return F.when(t > 0, F.round(F.lit(1.0) - t / 100.0, 2))


def classes(docs: DataFrame, id_col: str = "id", info_col: str = "info_json", geometry_col: str = "geometry") -> DataFrame:
    """One row for each class of each renderer: id, geometry, kind, field, ord, value, lower, and its symbol's properties.

    ord is -1 for the default. kind is simple, uniqueValue or classBreaks. lower is a class's own
    least value, else the largest of the class before, else the renderer's least.
    """
    info = docs.select(F.col(id_col).alias("id"), F.lower(geometry_col).alias("geometry"), F.from_json(info_col, SCHEMA).alias("i"))
    r = info.select("id", "geometry", opacity(F.col("i")).alias("opacity"), F.col("i.renderer").alias("r"))
    none = F.lit(None)
    row = lambda ord_, value, lower, symbol: F.struct(ord_.cast("int").alias("ord"), value.cast("string").alias("value"), lower.cast("double").alias("lower"), symbol.alias("symbol"))
    default = F.array(row(F.lit(-1), none, none, F.col("r.defaultSymbol")))
    simple = F.array(row(F.lit(-1), none, none, F.col("r.symbol")))
    unique = F.transform("r.uniqueValueInfos", lambda v, i: row(i, v["value"], none, v["symbol"]))
    breaks = F.col("r.classBreakInfos")
    before = lambda i: F.when(i == 0, F.col("r.minValue")).otherwise(F.get(breaks, i - 1)["classMaxValue"])
    stepped = F.transform(breaks, lambda b, i: row(F.when(F.coalesce(b["classMinValue"], before(i)).isNull() & (i == 0), -1).otherwise(i), none, F.coalesce(b["classMinValue"], before(i)), b["symbol"]))
    bare = F.exists(stepped, lambda s: s["ord"] == -1)
    kind = F.col("r.type")
    rows = F.when(kind == "simple", simple).when(kind == "uniqueValue", F.concat(F.filter(unique, lambda u: u["value"].isNotNull()), default)).when(kind == "classBreaks", F.when(bare, stepped).otherwise(F.concat(stepped, default)))
    delimiter = F.coalesce("r.fieldDelimiter", F.lit(","))
    out = r.select("id", "geometry", "opacity", kind.alias("kind"), F.coalesce("r.field1", "r.field").alias("field"), "r.field2", F.when(F.col("r.field2").isNotNull(), F.col("r.field3")).alias("field3"), delimiter.alias("delimiter"), F.explode(rows).alias("c"))
    s = F.col("c.symbol")
    line = F.when(F.col("geometry") == "line", F.struct(s["style"].alias("style"), s["color"].alias("color"), s["width"].alias("width"))).otherwise(F.struct(s["outline"]["style"].alias("style"), s["outline"]["color"].alias("color"), s["outline"]["width"].alias("width")))
    drawn = F.when(F.col("geometry") == "line", s["type"] == "esriSLS").otherwise(s["outline"].isNotNull()) & (F.coalesce(line["style"], F.lit("esriSLSSolid")) != "esriSLSNull")
    dash = F.lit(None).cast("array<double>")
    for name, pattern in DASHES.items():
        dash = F.when(line["style"] == name, F.array(*[F.lit(float(x)) for x in pattern])).otherwise(dash)
    filled = (s["type"] == "esriSFS") & (F.coalesce(s["style"], F.lit("esriSFSSolid")) != "esriSFSNull")
    picture = s["type"].isin("esriPMS", "esriPFS") & s["imageData"].isNotNull() & s["contentType"].isNotNull()
    return out.select(
        "id",
        "geometry",
        "opacity",
        "kind",
        "field",
        "field2",
        "field3",
        "delimiter",
        "c.ord",
        "c.value",
        "c.lower",
        s["type"].alias("symbol_type"),
        s["style"].alias("symbol_style"),
        F.when((F.col("geometry") == "point") & (s["type"] == "esriSMS"), css_color(s["color"])).when(filled, css_color(s["color"])).otherwise(TRANSPARENT).alias("color"),
        F.when(s["type"] == "esriSMS", pixels(F.coalesce(s["size"], F.lit(MARKER_POINTS)) / 2.0)).otherwise(0.0).alias("radius"),
        F.when(F.coalesce(drawn, F.lit(False)), css_color(line["color"])).otherwise(TRANSPARENT).alias("line_color"),
        F.when(F.coalesce(drawn, F.lit(False)), pixels(F.coalesce(line["width"], F.lit(LINE_POINTS)))).otherwise(0.0).alias("line_width"),
        F.when(F.coalesce(drawn, F.lit(False)), dash).alias("dash"),
        F.when(F.coalesce(picture, F.lit(False)), F.concat(F.lit("data:"), s["contentType"], F.lit(";base64,"), s["imageData"])).alias("image"),
        F.when(F.coalesce(picture, F.lit(False)), F.struct(pixels(F.coalesce(s["width"], s["height"], F.lit(PICTURE_POINTS))).alias("width"), pixels(F.coalesce(s["height"], s["width"], F.lit(PICTURE_POINTS))).alias("height"), F.pmod(-F.coalesce(s["angle"], F.lit(0.0)), F.lit(360.0)).alias("rotate"))).alias("image_size"),
    )


def losses(docs: DataFrame, id_col: str = "id", info_col: str = "info_json", geometry_col: str = "geometry") -> DataFrame:
    """(id, path, reason): what of a document is not carried over."""
    info = docs.select(F.col(id_col).alias("id"), F.lower(geometry_col).alias("geometry"), F.from_json(info_col, SCHEMA).alias("i"))
    r = F.col("i.renderer")
    rules = [
        (F.col("i").isNull() | r.isNull(), "renderer", "missing, nothing to draw"),
        (~r["type"].isin("simple", "uniqueValue", "classBreaks"), "renderer.type", "unknown renderer type"),
        (F.size(r["visualVariables"]) > 0, "renderer.visualVariables", "not translated"),
        (F.length(r["rotationExpression"]) > 0, "renderer.rotationExpression", "not translated"),
        ((r["type"] == "uniqueValue") & r["field1"].isNull(), "renderer.field1", "missing"),
        ((r["type"] == "uniqueValue") & r["field3"].isNotNull() & r["field2"].isNull(), "renderer.field3", "without a second field"),
        ((r["type"] == "classBreaks") & r["field"].isNull(), "renderer.field", "missing"),
        ((r["type"] == "classBreaks") & (F.length(r["normalizationType"]) > 0), "renderer.normalizationType", "raw values are stepped"),
        ((r["type"] == "classBreaks") & (F.size(r["classBreakInfos"]) > 0) & F.element_at(r["classBreakInfos"], -1)["classMaxValue"].isNotNull(), "renderer.classBreakInfos", "a step has no upper bound"),
    ]
    general = F.array(*[F.when(c, F.struct(F.lit(p).alias("path"), F.lit(t).alias("reason"))) for c, p, t in rules])
    first = info.select("id", F.explode(F.filter(general, lambda x: x.isNotNull())).alias("l")).select("id", "l.path", "l.reason")
    c = classes(docs, id_col, info_col, geometry_col)
    where = F.when(F.col("ord") < 0, F.lit("renderer.symbol")).otherwise(F.concat(F.lit("renderer.classes["), F.col("ord").cast("string"), F.lit("].symbol")))
    known = {"point": ("esriSMS", "esriPMS"), "line": ("esriSLS",), "polygon": ("esriSFS", "esriPFS")}
    fits = reduce(lambda a, g: F.when(F.col("geometry") == g, F.col("symbol_type").isin(*known[g])).otherwise(a), known, F.lit(False))
    per_class = [
        (F.col("symbol_type").isNotNull() & ~fits, "the symbol does not fit the geometry"),
        ((F.col("symbol_type") == "esriSMS") & (F.coalesce("symbol_style", F.lit("esriSMSCircle")) != "esriSMSCircle"), "drawn as a circle"),
        (F.col("symbol_style").isin(*HATCHES), "a hatch becomes solid"),
    ]
    own = F.array(*[F.when(cond, F.struct(where.alias("path"), F.lit(t).alias("reason"))) for cond, t in per_class])
    own = c.select("id", F.explode(F.filter(own, lambda x: x.isNotNull())).alias("l")).select("id", "l.path", "l.reason")
    patterns = c.filter("geometry IN ('line', 'polygon') AND line_width > 0").groupBy("id", "geometry").agg(F.count_distinct(F.coalesce(F.to_json("dash"), F.lit("none"))).alias("n"))
    path = F.when(F.col("geometry") == "line", "renderer.symbol.style").otherwise("renderer.symbol.outline.style")
    mixed = patterns.filter("n > 1").select("id", path.alias("path"), F.lit("one dash pattern for all classes, the first is taken").alias("reason"))
    return first.unionByName(own).unionByName(mixed)


def _branches(prop: Column, quoted: bool) -> Column:
    """One JSON expression of a property over a renderer's classes: a literal if all branches agree, else match or step."""
    value = lambda v: (F.concat(F.lit('"'), v.cast("string"), F.lit('"')) if quoted else v.cast("string"))
    entries = F.array_sort(F.collect_list(F.struct("ord", "value", "lower", prop.alias("v"))))
    cases = F.filter(entries, lambda e: e["ord"] >= 0)
    fallback = value(F.coalesce(F.get(F.filter(entries, lambda e: e["ord"] < 0), F.lit(0))["v"], F.lit(TRANSPARENT) if quoted else F.lit(0.0)))
    get = lambda f: F.concat(F.lit('["to-string",["get",'), F.to_json(F.struct(f.alias("f"))).substr(F.lit(6), F.length(F.to_json(F.struct(f.alias("f")))) - 6), F.lit("]]"))
    first = lambda c: F.first(c)
    f1, f2, f3 = first(F.col("field")), first(F.col("field2")), first(F.col("field3"))
    sep = F.concat(F.lit(',"'), first(F.col("delimiter")), F.lit('",'))
    key = F.when(f2.isNull(), get(f1)).otherwise(F.concat(F.lit('["concat",'), get(f1), sep, get(f2), F.when(f3.isNull(), "").otherwise(F.concat(sep, get(f3))), F.lit("]")))
    quoted_key = lambda e: F.regexp_extract(F.to_json(F.struct(e["value"].alias("v"))), r'^\{"v":(.*)\}$', 1)
    match = F.concat(F.lit('["match",'), key, F.lit(","), F.array_join(F.transform(cases, lambda e: F.concat(quoted_key(e), F.lit(","), value(e["v"]))), ","), F.lit(","), fallback, F.lit("]"))
    number = F.regexp_replace(get(f1), r'^\["to-string",(.*)\]$', "$1")
    step = F.concat(F.lit('["step",'), number, F.lit(","), fallback, F.lit(","), F.array_join(F.transform(cases, lambda e: F.concat(e["lower"].cast("string"), F.lit(","), value(e["v"]))), ","), F.lit("]"))
    same = F.size(F.array_distinct(F.transform(entries, lambda e: value(e["v"])))) == 1
    alone = F.size(cases) == 0
    return F.when(same & (F.exists(entries, lambda e: e["ord"] < 0) | alone) | alone, F.when(alone, fallback).otherwise(value(F.get(entries, F.lit(0))["v"]))).when(F.first("kind") == "uniqueValue", match).otherwise(step)


def layers(docs: DataFrame, id_col: str = "id", info_col: str = "info_json", geometry_col: str = "geometry") -> DataFrame:
    """(id, layer, kind, properties): style layers of each document, each property a JSON text for the expression compiler.

    Renderers of class breaks that don't ascend give no layer.
    """
    c = classes(docs, id_col, info_col, geometry_col)
    steps = F.filter(F.array_sort(F.collect_list(F.struct("ord", "lower"))), lambda e: e["ord"] >= 0)
    props = {"color": _branches(F.col("color"), True), "radius": _branches(F.col("radius"), False), "line_color": _branches(F.col("line_color"), True), "line_width": _branches(F.col("line_width"), False)}
    g = c.groupBy("id", "geometry").agg(
        *[v.alias(k) for k, v in props.items()],
        steps.alias("steps"),
        F.first("opacity").alias("opacity"),
        F.first("kind").alias("kind"),
        F.max(F.col("radius") > 0).alias("has_marker"),
        F.max(F.col("line_width") > 0).alias("has_line"),
        F.max(F.col("color") != TRANSPARENT).alias("has_fill"),
        F.min_by(F.struct("dash"), F.when(F.col("line_width") > 0, F.when(F.col("ord") < 0, 2**31 - 1).otherwise(F.col("ord")))).alias("first"),
    )
    pairs = F.transform(F.sequence(F.lit(1), F.size("steps")), lambda i: F.coalesce(F.get("steps", i)["lower"] > F.get("steps", i - 1)["lower"], F.lit(True)))
    g = g.filter((F.col("kind") != "classBreaks") | (F.size("steps") == 0) | F.forall(pairs, lambda x: x))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    seen = lambda *e: F.map_from_entries(F.filter(F.array(*e), lambda x: x["value"].isNotNull()))
    layer = lambda kind, when, *e: F.when(when, F.struct(F.lit(kind).alias("kind"), seen(*e).alias("properties")))
    dash = F.to_json("first.dash")
    found = F.array(
        layer("circle", (F.col("geometry") == "point") & F.col("has_marker"), entry("circle-color", F.col("color")), entry("circle-radius", F.col("radius")), entry("circle-opacity", F.col("opacity"))),
        layer("fill", (F.col("geometry") == "polygon") & F.col("has_fill"), entry("fill-color", F.col("color")), entry("fill-opacity", F.col("opacity"))),
        layer("outline", (F.col("geometry") == "polygon") & F.col("has_line"), entry("line-color", F.col("line_color")), entry("line-width", F.col("line_width")), entry("line-dasharray", dash), entry("line-opacity", F.col("opacity"))),
        layer("line", (F.col("geometry") == "line") & F.col("has_line"), entry("line-color", F.col("line_color")), entry("line-width", F.col("line_width")), entry("line-dasharray", dash), entry("line-opacity", F.col("opacity"))),
    )
    rows = g.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("l"))
    return rows.select("id", F.concat(F.col("id").cast("string"), F.lit("-"), F.col("l.kind")).alias("layer"), "l.kind", "l.properties")


def labels(docs: DataFrame, id_col: str = "id", info_col: str = "info_json") -> DataFrame:
    """(id, text_field, anchor, size, color, halo_color, halo_width): the first label class, `[FIELD]` texts as a concat expression.

    None where labels are hidden or the expression is a script.
    """
    i = docs.select(F.col(id_col).alias("id"), F.from_json(info_col, SCHEMA).alias("i"))
    l = F.get("i.labelingInfo", F.lit(0))
    text = l["labelExpression"]
    rows = i.filter(F.coalesce(F.col("i.showLabels"), F.lit(True)) & text.isNotNull() & ~text.rlike(r"(?i)function|return|\$feature|CONCAT\("))
    pieces = F.regexp_extract_all(text, F.lit(r"\[[^\]]+\]|[^\[\]]+"), F.lit(0))
    part = lambda p: F.when(p.startswith("["), F.concat(F.lit('["to-string",["get","'), F.substring(p, F.lit(2), F.length(p) - 2), F.lit('"]]'))).otherwise(F.concat(F.lit('"'), F.btrim(p, F.lit('"')), F.lit('"')))
    expression = F.concat(F.lit('["concat",'), F.array_join(F.transform(pieces, part), ","), F.lit("]"))
    anchor = F.lit(None).cast("string")
    for name, a in ANCHORS.items():
        anchor = F.when(l["labelPlacement"] == name, a).otherwise(anchor)
    s = l["symbol"]
    return rows.select("id", expression.alias("text_field"), anchor.alias("anchor"), pixels(s["font"]["size"]).alias("size"), css_color(s["color"]).alias("color"), css_color(s["haloColor"]).alias("halo_color"), pixels(s["haloSize"]).alias("halo_width"))
