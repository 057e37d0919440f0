"""Operators that spread one key, one cell or one column of values over many tasks, against plain versions."""

from __future__ import annotations

import bisect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolake.operators import classify, cluster, labels, ranges, raster, temporal, terrain


def dbscan_by_hand(pts, eps, least):
    near = {a: [b for b in pts if a != b and (pts[a][0] - pts[b][0]) ** 2 + (pts[a][1] - pts[b][1]) ** 2 <= eps * eps] for a in pts}
    cores = {a for a in pts if len(near[a]) >= least}
    label, number = {}, 0
    for a in sorted(cores):
        if a not in label:
            stack = [a]
            while stack:
                p = stack.pop()
                if label.setdefault(p, number) == number:
                    stack += [q for q in near[p] if q in cores and q not in label]
            number += 1
    border = {a: min(label[b] for b in near[a] if b in cores) for a in pts if a not in cores and any(b in cores for b in near[a])}
    return {(a, label.get(a, border.get(a)), a in cores) for a in pts}


@pytest.mark.parametrize(("seed", "eps", "least"), [(1, 1.0, 3), (2, 0.4, 1), (3, 2.5, 12)])
def test_dbscan_equals_plain_search(spark, seed, eps, least, monkeypatch):
    monkeypatch.setattr(cluster, "FEW_PAIRS", 4)  # boxes shrink more often
    rng = random.Random(seed)
    spots = [(rng.gauss(cx, 0.7), rng.gauss(cy, 0.7)) for cx, cy in ((0, 0), (-5, 3), (4, 4)) for _ in range(70)]
    spots += [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(60)] + [(3.0, -6.0)] * 20 + [(3.0 + eps, -6.0), (0.0, -8.0), (eps, -8.0)]
    pts = {i * 7 % 1009: p for i, p in enumerate(spots)}
    df = spark.createDataFrame([(k, *p) for k, p in pts.items()], "fid long, x double, y double")
    got = {tuple(r) for r in cluster.dbscan(df, eps, least).collect()}
    assert got == dbscan_by_hand(pts, eps, least)


def test_dbscan_of_one_full_cell_and_its_border(spark):
    n = 200_000
    crowd = spark.range(n).select(F.col("id").alias("fid"), (F.rand(1) * 0.6).alias("x"), (F.rand(2) * 0.6).alias("y"))
    rest = spark.createDataFrame([(n, 1.5, 0.3), (n + 1, 1.55, 0.3), (n + 2, 1.7, 0.3), (n + 3, None, 0.3), (n + 4, 0.3, None)], "fid long, x double, y double")
    out = cluster.dbscan(crowd.unionByName(rest), 1.0, 4)
    assert {tuple(r) for r in out.filter(F.col("fid") >= n).collect()} == {(n, 0, True), (n + 1, 0, True), (n + 2, 0, False), (n + 3, None, False), (n + 4, None, False)}
    assert out.filter("cluster = 0 AND core").count() == n + 2


def best_cost(x, k):
    n, s1, s2 = len(x), np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(x * x)]
    cost = np.r_[0, np.full(n, np.inf)]
    for _ in range(k):
        cost = np.array([np.inf] + [min(cost[a] + s2[e] - s2[a] - (s1[e] - s1[a]) ** 2 / (e - a) for a in range(e)) for e in range(1, n + 1)])
    return cost[n]


@pytest.mark.parametrize(("seed", "k", "rows"), [(1, 3, 8), (2, 4, 3), (3, 2, 1 << 16)])
def test_natural_breaks_in_segments_cost_least(spark, seed, k, rows):
    rng = np.random.default_rng(seed)
    x = np.unique(np.r_[rng.normal(1000, 1, 60), rng.normal(1009, 2, 50), 1000 + rng.exponential(5, 50)].round(2))
    rows_ = spark.createDataFrame([(float(v),) for v in [*x, *x[:5]]] + [(None,), (float("nan"),)], "v double")
    breaks = classify.natural_breaks(rows_, "v", k, rows)
    cuts = [0, *[bisect.bisect_left(x, b) for b in breaks], len(x)]
    assert len(breaks) == k - 1 and breaks == sorted(breaks)
    assert sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(cuts, cuts[1:], strict=False)) == pytest.approx(best_cost(x - 1000, k))


def test_one_entity_over_many_ranges(spark):
    rng = random.Random(4)
    points = [(e, float(rng.randint(0, 400)), rng.random(), rng.random()) for e in (1, 1, 1, 1, 1, 2, None) for _ in range(80)] + [(3, 5.0, 1.0, 1.0)]
    asked = [(e, t / 2) for e in (1, 2, 3, 4, None) for t in range(-4, 820, 9)]
    df = spark.createDataFrame(points, "entity long, t double, x double, y double").repartition(6)
    times = spark.createDataFrame(asked, "entity long, at double")
    got = {(r["entity"], r["at"]): (r["x"], r["y"]) for r in temporal.trajectory_at(df, times).collect()}
    want = {}
    for e, at in asked:
        own = sorted((t, x, y) for k, t, x, y in points if k == e)
        before, after = [p for p in own if p[0] < at], [p for p in own if p[0] >= at]
        if not own:
            continue
        a, b = before[-1] if before else None, after[0] if after else None
        part = (at - a[0]) / (b[0] - a[0]) if a and b else 0
        want[e, at] = tuple(a[i] + (b[i] - a[i]) * part for i in (1, 2)) if a and b else (a or b)[1:]
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    got = [r["number"] for r in ranges.numbered(df, "v").orderBy("v").collect()]
    assert got == list(range(1000))
    assert ranges.numbered(df.limit(0), "v").count() == 0


def placed_by_hand(rows, width, height, pad, by_priority, lower_left=True):
    """The labels of all canvases in one pass, without cells or tiles."""
    taken, out = {}, set()
    for c, fid, text, x, y, w, h, p in sorted(rows, key=lambda r: (-r[7] if by_priority else 0, r[1])):
        dx, dy = w + 2 * pad, h + 2 * pad
        spots = [(x, y), (x + dx, y), (x - dx, y), (x, y - dy), (x, y + dy), (x + dx, y - dy), (x - dx, y - dy), (x + dx, y + dy)] + [(x - dx, y + dy)] * lower_left
        for a, b in spots if by_priority else spots[:1]:
            if by_priority and (a < 0 or b < 0 or a + w > width or b + h > height):
                continue
            q = pad if by_priority else 0
            box = (a - q, b - q, a + w + q, b + h + q)
            if not any(box[0] < t[2] and box[2] > t[0] and box[1] < t[3] and box[3] > t[1] for t in taken.get(c, ())):
                taken.setdefault(c, []).append(box)
                out.add((c, fid, text, a, b, w, h, p))
                break
    return out


@pytest.mark.parametrize(("seed", "by_priority", "lower_left"), [(1, True, True), (2, True, False), (3, False, True)])
def test_labels_in_rounds_equal_one_pass(spark, seed, by_priority, lower_left):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", None, "b"]), i, f"t{i}", float(rng.randint(0, 560)), float(rng.randint(0, 300)), float(rng.randint(4, 40)), 8.0, rng.randint(0, 4)) for i in range(500)]
    rows += [("row", 1000 + i, "r", 30.0 * i, 10.0, 29.0, 8.0, 1) for i in range(40)]
    df = spark.createDataFrame([*rows, ("a", 9, "no place", None, 1.0, 1.0, 1.0, 9)], "canvas string, fid long, text string, x double, y double, width double, height double, priority int")
    out = labels.place_labels(df, 600, 320, by_priority=by_priority, lower_left=lower_left, per_tile=12)
    assert {tuple(r) for r in out.collect()} == placed_by_hand(rows, 600, 320, 2.0, by_priority, lower_left)
    assert labels.place_labels(df.limit(0), 600, 320).count() == 0


@pytest.mark.parametrize("by_priority", [True, False])
def test_a_crowd_on_few_spots_enters_the_rounds_with_few_labels(spark, by_priority, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b"]), i, "t", 25.0 * (i % 12), 9.0 * (i % 5), 20.0, 8.0, rng.choice([None, 0, 1])) for i in range(3000)]
    df = spark.createDataFrame(rows, "canvas string, fid long, text string, x double, y double, width double, height double, priority int")
    tables, keep = [], labels.kept
    monkeypatch.setattr(labels, "kept", lambda d: tables.append(keep(d)) or tables[-1])
    out = {tuple(r) for r in labels.place_labels(df, 320, 90, by_priority=by_priority).collect()}
    # null priorities come last
    want = placed_by_hand([(*r[:7], -1 if r[7] is None else r[7]) for r in rows], 320, 90, 2.0, by_priority)
    assert {(*r[:7], -1 if r[7] is None else r[7]) for r in out} == want
    assert tables[1].count() <= 2 * 60 * (9 if by_priority else 1)
    # labels without extent take no room, so all stay
    flat = df.withColumns({"width": F.lit(0.0), "height": F.lit(0.0)})
    assert labels.place_labels(flat, 320, 90, by_priority=False).count() == 3000


@pytest.mark.parametrize("smooth", [False, True])
@pytest.mark.parametrize("cap", ["butt", "round", "square"])
def test_strokes_equal_all_pixels_tried(spark, cap, smooth):
    rng = random.Random(6)
    lines = [(k, rng.uniform(-5, 45), rng.uniform(-5, 45), rng.uniform(-5, 45), rng.uniform(-5, 45), rng.choice([1.0, 2.5, 6.0])) for k in range(12)]
    lines += [(20, 3.0, 3.0, 30.0, 3.0, 3.0), (21, 5.0, 2.0, 5.0, 30.0, 3.0), (22, 9.0, 9.0, 9.0, 9.0, 4.0), (23, -1e12, 0.0, 1e12, 40.0, 2.0), (24, 1.0, 20.0, 38.0, 20.5, 1.0)]
    rgba = F.struct(*[F.lit(v).alias(c) for v, c in ((9, "r"), (9, "g"), (9, "b"), (200, "a"))])
    df = spark.createDataFrame([("c", 0, *r) for r in lines], "canvas string, layer_ord int, fid long, x0 double, y0 double, x1 double, y1 double, line_width double").withColumn("rgba", rgba)
    got = {(r["fid"], r["px"], r["py"]): r["rgba"]["a"] for r in raster.strokes(df, 40, 36, cap, smooth).collect()}
    want = {}
    for fid, x0, y0, x1, y1, w in lines:
        dx, dy, half = x1 - x0, y1 - y0, w / 2
        size = dx * dx + dy * dy
        for px in range(40):
            for py in range(36):
                ux, uy = px + 0.5 - x0, py + 0.5 - y0
                along = (ux * dx + uy * dy) / (size or 1)
                t = min(1, max(0, along))
                d = ((ux - dx * t) ** 2 + (uy - dy * t) ** 2) ** 0.5 if cap == "round" else abs(ux * dy - uy * dx) / (size or 1) ** 0.5
                cover = min(1, half + 0.5 - d) if smooth else float(d <= half)
                longer = half / size**0.5 if cap == "square" and size else 0
                if cap != "round" and not (size > 0 and -longer <= along <= 1 + longer):
                    cover = 0
                if cover > 0:
                    want[fid, px, py] = int(200 * cover) if smooth else 200
    assert got == want


def test_a_long_diagonal(spark):
    n = 2000
    df = spark.createDataFrame([("c", 0, 1, 0.0, 0.0, float(n), float(n), 2.0)], "canvas string, layer_ord int, fid long, x0 double, y0 double, x1 double, y1 double, line_width double").withColumn("rgba", F.struct(*[F.lit(9).alias(c) for c in "rgba"]))
    out = raster.strokes(df, n, n)
    assert n < out.count() < 6 * n


def over_by_hand(under, top):
    a, b = top[3] / 255, under[3] / 255
    out = a + b * (1 - a)
    if not out:
        return (0, 0, 0, 0)
    return (*[int((top[i] / 255 * a + under[i] / 255 * b * (1 - a)) / out * 255) for i in range(3)], int(out * 255))


PIXEL = "canvas string, layer_ord int, fid long, px int, py int, rgba struct<r:int,g:int,b:int,a:int>, solid boolean"


def test_stacks_over_many_ranges_equal_one_fold(spark):
    rng = random.Random(8)
    rows = []
    for n, spot in ((900, ("a", 3, 3)), (400, (None, 0, 0)), (300, ("a", 4, 3)), (5, ("b", 9, 9))):
        for i in range(n):
            alpha = rng.choice([0, 1, 2, 3, 9, 40]) if spot[1] != 4 else rng.choice([0, 1, 2, 90, 255])
            rows.append((spot[0], rng.randint(0, 3), i, spot[1], spot[2], (*[rng.randint(0, 255) for _ in range(3)], alpha), rng.random() < (0.01 if spot[1] == 4 else 0)))
    rows += [("c", 0, i, rng.randint(0, 30), rng.randint(0, 30), (*[rng.randint(0, 255) for _ in range(3)], rng.choice([30, 128, 255])), rng.random() < 0.1) for i in range(3000)]
    rows += rows[:50] + [("a", 1, 5, 3, 3, None, False), ("a", None, None, 3, 3, (1, 2, 3, 200), None)]
    want = {}
    for c, _, _, px, py, rgba, solid in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], -1 if r[2] is None else r[2], r[5] or (), bool(r[6]))):
        if rgba:
            want[c, px, py] = rgba if solid else over_by_hand(want.get((c, px, py), (0, 0, 0, 0)), rgba)
    df = spark.createDataFrame(rows, PIXEL).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {(r["canvas"], r["px"], r["py"]): tuple(r["rgba"]) for r in raster.blend(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert raster.blend(df.limit(0)).count() == 0


def test_a_million_layers_on_one_pixel(spark):
    n = 1_000_000
    channel = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(256)).cast("int")
    rows = spark.range(n).select(F.lit("a").alias("canvas"), F.lit(0).alias("layer_ord"), F.col("id").alias("fid"), F.lit(1).alias("px"), F.lit(1).alias("py"), F.struct(channel(1).alias("r"), channel(2).alias("g"), channel(3).alias("b"), (channel(4) % 60).alias("a")).alias("rgba"))
    last = sorted((r["fid"], tuple(r["rgba"])) for r in rows.filter(F.col("fid") >= n - 3000).collect())
    want = (0, 0, 0, 0)
    for _, rgba in last:  # 3,000 layers hide what is below them
        want = over_by_hand(want, rgba)
    assert [tuple(r["rgba"]) for r in raster.blend(rows).collect()] == [want]


@pytest.mark.parametrize("block", [3, 256])
def test_contours_are_whole_lines_over_blocks(spark, block, monkeypatch):
    """Two round hills and a slope: rings closed, each line's points follow the pieces, whatever the blocks."""
    monkeypatch.setattr(terrain, "BLOCK", block)
    height = lambda r, c: 40 * np.exp(-((r - 9) ** 2 + (c - 9) ** 2) / 30) + 33 * np.exp(-((r - 20) ** 2 + (c - 22) ** 2) / 40) + c * 0.31
    grid = [(r, c, float(height(r, c))) for r in range(30) for c in range(32)] + [(31, 5, None)]
    dem = spark.createDataFrame(grid, "row int, col int, elev double")
    pieces = {}
    for p in terrain.contour_lines(dem, 7.0, 14.0).collect():
        ends = [(round(p["x1"], 9), round(p["y1"], 9)), (round(p["x2"], 9), round(p["y2"], 9))]
        pieces.setdefault(p["level"], []).append(frozenset(ends))
    got, lines = {}, terrain.contour_polylines(dem, 7.0, 14.0).collect()
    for line in lines:
        pts = [(round(p["x"], 9), round(p["y"], 9)) for p in line["pts"]]
        assert (pts[0] == pts[-1]) == line["closed"]
        got.setdefault(line["level"], []).extend(frozenset(s) for s in zip(pts, pts[1:], strict=False))
    key = lambda s: sorted(s)
    assert {k: sorted(map(key, v)) for k, v in got.items()} == {k: sorted(map(key, v)) for k, v in pieces.items()}
    # a line for each component of the pieces
    components = 0
    for own in pieces.values():
        parent = {}

        def root(a, parent=parent):
            while parent.setdefault(a, a) != a:
                a = parent[a]
            return a

        for s in own:
            ends = list(s)
            parent[root(ends[0])] = root(ends[-1])
        components += len({root(a) for a in list(parent)})
    assert len(lines) == components and sum(x["closed"] for x in lines) >= 6
    assert terrain.contour_polylines(dem.limit(0)).count() == 0


def test_only_chains_on_seams_are_jumped_and_doubled_cells_count_once(spark, monkeypatch):
    grid = [(r, c, c * 3.1 + r % 5 * 0.4) for r in range(1, 31) for c in range(1, 33)]
    odd = [(r, c, e - 9.0) for r, c, e in grid[::7]] + [(40, 3, float("nan")), (40, 4, 1.0), (41, 3, 20.0), (41, 4, 9.0), (None, 3, 1.0)]
    dem = spark.createDataFrame(grid + odd, "row int, col int, elev double")
    jumped, jump = [], terrain._jumped
    monkeypatch.setattr(terrain, "_jumped", lambda links: jumped.append(links.count()) or jump(links))
    whole = sorted(terrain.contour_polylines(dem, 7.0, 14.0).collect())
    assert jumped == [0, 0] and len(whole) == 14 and not any(x["closed"] for x in whole)
    assert min(len(x["pts"]) for x in whole) >= 30
    monkeypatch.setattr(terrain, "BLOCK", 4)
    assert sorted(terrain.contour_polylines(dem, 7.0, 14.0).collect()) == whole and jumped[2] > 14


def icon_by_hand(x, y, w, h, scale, turn, anchor, width, height):
    """Target pixel to icon pixel, every pixel of the canvas tried."""
    sw, sh = int(w * scale), int(h * scale)
    x0 = int(x) - (0 if "left" in anchor else sw if "right" in anchor else sw // 2)
    y0 = int(y) - (0 if "top" in anchor else sh if "bottom" in anchor else sh // 2)
    out = {}
    for px in range(width):
        for py in range(height):
            lx, ly = px - x0, py - y0
            if turn:
                c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
                rx, ry = px + 0.5 - x, py + 0.5 - y
                lx, ly = x + rx * c + ry * s - x0, y - rx * s + ry * c - y0
            if 0 <= lx < sw and 0 <= ly < sh:
                out[px, py] = (min(int(lx / scale), w - 1), min(int(ly / scale), h - 1))
    return out


@pytest.mark.parametrize("anchor", ["center", "top-left", "bottom", "right"])
def test_icons_equal_all_pixels_tried(spark, anchor):
    rng = random.Random(12)
    rows = [("c", 0, i, rng.uniform(-4, 44), rng.uniform(-4, 40), rng.choice(["a", "b"]), rng.choice([0.3, 0.5, 1.0, 1.7, 3.0]), rng.choice([0.0, 90.0, 33.0, -120.0]), rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(60)]
    odd = [("c", 0, 100, None, 1.0, "a", 1.0, 0.0, 0.0, 0.0), ("c", 0, 101, 5.0, 5.0, "none", 1.0, 0.0, 0.0, 0.0), ("c", 0, 102, 5.0, 5.0, None, 1.0, 0.0, 0.0, 0.0), ("c", 0, 103, 5.0, 5.0, "a", -2.0, 0.0, 0.0, 0.0), ("c", 0, 104, 1e13, -1e13, "a", 1.0, 20.0, 0.0, 0.0), ("c", 0, 105, 9.5, 9.5, "a", None, None, None, None)]
    kind = "canvas string, layer_ord int, fid long, x double, y double, icon string, scale double, rotation double, dx double, dy double"
    size = {"a": (5, 3), "b": (4, 6)}
    pixels = [(k, u, v, (u, v, ord(k), 255)) for k, (w, h) in size.items() for u in range(w) for v in range(h) if (u, v) != (1, 1)]
    atlas = spark.createDataFrame(pixels, "icon string, u int, v int, rgba struct<r:int,g:int,b:int,a:int>")
    got = {(r["fid"], r["px"], r["py"]): tuple(r["rgba"])[:3] for r in raster.icons(spark.createDataFrame(rows + odd, kind), atlas, 40, 36, anchor).collect()}
    want = {}
    for _, _, fid, x, y, name, scale, turn, dx, dy in [*rows, ("c", 0, 105, 9.5, 9.5, "a", 1.0, 0.0, 0.0, 0.0)]:
        for (px, py), (u, v) in icon_by_hand(x + dx, y + dy, *size[name], scale, turn, anchor, 40, 36).items():
            if (u, v) != (1, 1):  # a clear pixel
                want[fid, px, py] = (u, v, ord(name))
    assert got == want
