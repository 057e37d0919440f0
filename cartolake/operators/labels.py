"""Labels: greedy placement on canvases, wrapping, and text along lines.

Placement goes in rounds over tiles of each canvas and gives what one pass over its labels would.
Labels of different canvases don't see each other.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolake.operators.geometry import at_distance, path_length
from cartolake.operators.scratch import kept

PADDING = 2.0
#: Labels that a tile of a canvas should hold: what one task decides in a round.
LABELS_A_TILE = 20_000
MAX_TURN = 0.4
LINE_SHARE = 0.8

Box = tuple[float, float, float, float]
#: Rows of a tile: boxes that stand, labels of its own, and labels of other tiles within reach.
PLACED, OWN, FOREIGN = 0, 1, 2


def _overlaps(boxes: dict[tuple[int, int], list[Box]], box: Box) -> bool:
    return any(box[0] < t[2] and box[2] > t[0] and box[1] < t[3] and box[3] > t[1] for cell in _cells(box) for t in boxes.get(cell, ()))


def _add(boxes: dict[tuple[int, int], list[Box]], box: Box) -> None:
    for cell in _cells(box):
        boxes.setdefault(cell, []).append(box)


def _cells(box: Box, size: float = 50.0) -> list[tuple[int, int]]:
    xs = range(math.floor(box[0] / size), math.floor(box[2] / size) + 1)
    return [(x, y) for x in xs for y in range(math.floor(box[1] / size), math.floor(box[3] / size) + 1)]


_DECIDED = "uid long, px double, py double"


def _decide(width: float, height: float, pad: float, by_priority: bool, lower_left: bool):
    """One tile's part of a round: its own labels in order, as far as no room that they want may go to an earlier open label.

    Room that is taken stays so. A label without free room left is out, whatever waits, and an open
    one keeps others from its free room only. What is out at a spot is out for all later labels of its size there.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        order = ["priority", "fid", "uid"] if by_priority else ["fid", "uid"]
        there = pdf[pdf["kind"] == PLACED]
        pdf = pdf[pdf["kind"] != PLACED].sort_values(order, ascending=[False, True, True] if by_priority else True, kind="stable")
        taken: dict[tuple[int, int], list[Box]] = {}
        waiting: dict[tuple[int, int], list[Box]] = {}
        full: set[Box] = set()
        for r in there.itertuples(index=False):
            _add(taken, (r.x0, r.y0, r.x1, r.y1))
        out = []
        for r in pdf.itertuples(index=False):
            spot = (r.x, r.y, r.width, r.height)
            free = []
            for x, y in () if spot in full else _spots(spot, width, height, pad, by_priority, lower_left):
                box = (x - pad, y - pad, x + r.width + pad, y + r.height + pad)
                if not _overlaps(taken, box):
                    free.append((x, y, box))
                    if r.kind == OWN and len(free) == 1 and not _overlaps(waiting, box):
                        break
            else:
                if free:
                    for _, _, box in free:
                        _add(waiting, box)
                    continue
            if free:
                _add(taken, free[0][2])
            else:
                full.add(spot)
            if r.kind == OWN:
                out.append((r.uid, *(free[0][:2] if free else (None, None))))
        return pd.DataFrame(out, columns=["uid", "px", "py"]).astype({"uid": "int64", "px": "float64", "py": "float64"})

    return run


def _spots(label: Box, width: float, height: float, pad: float, by_priority: bool, lower_left: bool) -> list[tuple[float, float]]:
    """The places that a label (x, y, width, height) tries, in order."""
    x, y, w, h = label
    if not by_priority:
        return [(x, y)]
    dx, dy = w + 2 * pad, h + 2 * pad
    moves = [(0, 0), (dx, 0), (-dx, 0), (0, -dy), (0, dy), (dx, -dy), (-dx, -dy), (dx, dy)] + ([(-dx, dy)] if lower_left else [])
    return [(x + mx, y + my) for mx, my in moves if not (x + mx < 0 or y + my < 0 or x + mx + w > width or y + my + h > height)]


def _eligible(rows: DataFrame, pad: float, by_priority: bool, most: int) -> DataFrame:
    """The first labels of each size at each spot, as many as there are places to try.

    Labels of one size at one spot try the same places: each that is placed takes one of them, and
    after one that is not no other is. A box without extent takes nothing, so such labels all stay.
    """
    solid = (F.col("width") + 2 * pad > 0) & (F.col("height") + 2 * pad > 0)
    order = ([F.desc_nulls_last("priority")] if by_priority else []) + [F.asc_nulls_last("fid"), F.col("uid")]
    inside = Window.partitionBy("sheet", "x", "y", "width", "height").orderBy(*order)
    first = rows.filter(solid).withColumn("_rank", F.row_number().over(inside)).filter(F.col("_rank") <= most).drop("_rank")
    return first.unionByName(rows.filter(~solid))


def place_labels(labels: DataFrame, width: float, height: float, padding: float = PADDING, by_priority: bool = True, lower_left: bool = True, per_tile: int = LABELS_A_TILE) -> DataFrame:
    """Labels (canvas, fid, text, x, y, width, height, priority) that find room, with their place.

    by_priority: highest priority first, ties by fid, at the wanted place or beside it (right, left,
    above, below, and the corners). Else in order of fid at the wanted place alone, ignoring
    priority and the canvas's edge. Boxes are padded on both sides. Without lower_left that
    corner isn't tried. The result is that of one pass over all labels of a canvas, but goes in
    rounds: a label is decided once no earlier one that is open could take its room. Each tile of a
    canvas decides its own labels as far as none waits for a label of another tile; tiles lie
    elsewhere in the next round. Of labels of one size on one spot only as many go into the rounds
    as there are places to try. Tiles hold about per_tile labels, more where many spots lie close. Labels
    without a place or a size are left out.
    """
    pad = float(padding) if by_priority else 0.0
    dx, dy = (F.col("width") + 2 * pad, F.col("height") + 2 * pad) if by_priority else (F.lit(0.0), F.lit(0.0))
    rows = labels.select(F.col("canvas").cast("string").alias("canvas"), F.col("fid").cast("long").alias("fid"), "text", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")], F.col("priority").cast("int").alias("priority"))
    rows = rows.dropna(subset=["x", "y", "width", "height"])
    reach = {"x0": F.col("x") - dx - pad, "y0": F.col("y") - dy - pad, "x1": F.col("x") + F.col("width") + dx + pad, "y1": F.col("y") + F.col("height") + dy + pad}
    rows = kept(rows.withColumns(reach).withColumns({"uid": F.monotonically_increasing_id(), "sheet": F.coalesce(F.concat(F.lit("="), F.col("canvas")), F.lit(""))}))
    rows = kept(_eligible(rows, pad, by_priority, 8 + lower_left if by_priority else 1))
    most = rows.agg(F.max(F.greatest(F.col("x1") - F.col("x"), F.col("x") - F.col("x0"))).alias("rx"), F.max(F.greatest(F.col("y1") - F.col("y"), F.col("y") - F.col("y0"))).alias("ry"), F.max("x").alias("hx"), F.min("x").alias("lx"), F.max("y").alias("hy"), F.min("y").alias("ly"), F.count("*").alias("n"), F.approx_count_distinct("sheet").alias("sheets")).first()
    if not most["n"]:
        return rows.select("canvas", "fid", "text", "x", "y", "width", "height", "priority")
    share = math.sqrt(max((most["hx"] - most["lx"]) * (most["hy"] - most["ly"]) * most["sheets"] * per_tile / most["n"], 1.0))
    side = {"x": max(share, 4 * most["rx"]), "y": max(share, 4 * most["ry"])}
    open_, placed, parts, turn = rows, None, [], 0
    while True:
        tile = lambda c, axis: F.floor((c + side[axis] * (turn % 3) / 3) / side[axis])  # noqa: E731, B023
        spread = lambda df: df.withColumn("tx", F.explode(F.sequence(tile(F.col("x0") - most["rx"], "x"), tile(F.col("x1") + most["rx"], "x")))).withColumn("ty", F.explode(F.sequence(tile(F.col("y0") - most["ry"], "y"), tile(F.col("y1") + most["ry"], "y"))))  # noqa: E731, B023
        columns = ["sheet", "uid", "fid", "priority", "x", "y", "width", "height", "x0", "y0", "x1", "y1"]
        here = spread(open_.select(*columns, tile(F.col("x"), "x").alias("ox"), tile(F.col("y"), "y").alias("oy")))
        here = here.withColumn("kind", F.when((F.col("tx") == F.col("ox")) & (F.col("ty") == F.col("oy")), OWN).otherwise(FOREIGN)).drop("ox", "oy")
        own = open_.select("sheet", tile(F.col("x"), "x").alias("tx"), tile(F.col("y"), "y").alias("ty")).distinct()
        if placed is not None:
            here = here.unionByName(spread(placed).withColumn("kind", F.lit(PLACED)), allowMissingColumns=True)
        here = here.join(own, ["sheet", "tx", "ty"], "left_semi")
        decided = kept(here.groupBy("sheet", "tx", "ty").applyInPandas(_decide(width, height, pad, by_priority, lower_left), _DECIDED))
        fits = kept(rows.join(decided.filter("px IS NOT NULL"), "uid"))
        parts.append(fits.select("canvas", "fid", "text", F.col("px").alias("x"), F.col("py").alias("y"), "width", "height", "priority"))
        boxes = fits.select("sheet", (F.col("px") - pad).alias("x0"), (F.col("py") - pad).alias("y0"), (F.col("px") + F.col("width") + pad).alias("x1"), (F.col("py") + F.col("height") + pad).alias("y1"))
        placed = boxes if placed is None else placed.unionByName(boxes)
        open_ = kept(open_.join(decided.select("uid"), "uid", "left_anti"))
        if not open_.limit(1).count():
            break
        turn += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def wrap(text: Column, max_width: float | None, size: float = 1.0) -> Column:
    """Lines of at most floor(max_width / (5 * size)) bytes, broken at spaces; longer words stay whole."""
    if max_width is None:
        return F.array(text)
    most = int(max_width // (5 * size))
    empty = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(s: Column, word: Column) -> Column:
        joined = F.concat(s["line"], F.lit(" "), word)
        fits = F.octet_length(joined) <= most
        first = s["line"] == ""
        return F.struct(F.when(first | fits, s["lines"]).otherwise(F.concat(s["lines"], F.array(s["line"]))).alias("lines"), F.when(first, word).when(fits, joined).otherwise(word).alias("line"))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.aggregate(words, empty, step, lambda s: F.when(s["line"] == "", s["lines"]).otherwise(F.concat(s["lines"], F.array(s["line"]))))


def along_line(pts: Column, text: Column, widths: Column, offset: float = 0.0, max_turn: float = MAX_TURN) -> Column:
    """Characters centred along a line: array of (ch, x, y, angle).

    Null if the text is empty, takes more than LINE_SHARE of the line, or turns more than max_turn
    from one character to the next.
    """
    total = path_length(pts)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.least(F.size(chars), F.size(widths))
    sums = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.aggregate(F.slice(widths, 1, i), F.lit(0.0), lambda a, b: a + b) - F.get(widths, i - 1) / 2.0)
    text_width = F.aggregate(widths, F.lit(0.0), lambda a, b: a + b)
    start = (total - text_width) / 2.0

    # bound once: an expression that is used again would be computed again
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def one(middle: Column, i: Column) -> Column:
        lifted = lambda p: F.struct(F.get(chars, i).alias("ch"), (p["x"] - F.sin(p["angle"]) * offset).alias("x"), (p["y"] + F.cos(p["angle"]) * offset).alias("y"), p["angle"].alias("angle"))
        return let(at_distance(pts, start + middle), lifted)

    def smooth(placed: Column) -> Column:
        n = F.greatest(F.size(placed) - 1, F.lit(0))
        turns = F.zip_with(F.slice(placed, 1, n), F.slice(placed, 2, n), lambda a, b: F.abs(b["angle"] - a["angle"]))
        sharp = F.exists(turns, lambda d: F.when(d > math.pi, 2 * math.pi - d).otherwise(d) > max_turn)
        return F.when(~sharp & F.forall(placed, lambda p: p["angle"].isNotNull()), placed)

    fits = (F.length(text) > 0) & (F.size(pts) >= 2) & (text_width <= total * LINE_SHARE)
    return F.when(fits, let(F.transform(sums, one), smooth))
