"""Point clustering by grid, over zooms, and by density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.operators.ranges import numbered
from cartolake.operators.scratch import kept


def _cells(points: DataFrame, keys: list[str], min_points: int, members: bool) -> DataFrame:
    """Cells with enough points as clusters; the points of others as clusters of one."""
    sums = [F.count("*").alias("count"), F.avg("x").alias("x"), F.avg("y").alias("y")]
    sizes = points.groupBy(*keys).agg(*sums)
    full = sizes.filter(F.col("count") >= min_points)
    if members:
        lists = points.groupBy(*keys).agg(*sums, F.sort_array(F.collect_list("fid")).alias("members"))
        full = lists.filter(F.col("count") >= min_points)
    small = sizes.filter(F.col("count") < min_points).select(*keys)
    alone = points.join(small, keys, "left_semi").select(*keys, F.lit(1).cast("long").alias("count"), "x", "y", *([F.array("fid").alias("members")] if members else []))
    return full.select(*alone.columns).unionByName(alone)


def grid_clusters(points: DataFrame, radius: float = 0.05, min_points: int = 2, members: bool = False) -> DataFrame:
    """(cx, cy, count, x, y, members) for points (fid, x, y): cells of twice the radius, centroids as means.

    members collects a cell's ids, so leave it out where a cell may hold a large part of all points.
    """
    size = radius * 2
    cells = points.select("fid", "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    return _cells(cells, ["cx", "cy"], min_points, members)


def hierarchical_clusters(points: DataFrame, min_zoom: int, max_zoom: int, radius: float, members: bool = False) -> DataFrame:
    """grid_clusters for each zoom z at radius / 2^z, two points at least.

    Cells nest, so points are summed once, at the deepest zoom, and those sums over all zooms; a
    cell of one point is that point. members explodes the points themselves over the zooms.
    """
    size = F.lit(radius * 2.0) / F.pow(F.lit(2.0), F.col("z").cast("double"))
    zooms = F.sequence(F.lit(min_zoom), F.lit(max_zoom))
    if members:
        rows = points.select("fid", "x", "y", F.explode(zooms).alias("z"))
        cells = rows.select("fid", "x", "y", "z", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
        return _cells(cells, ["z", "cx", "cy"], 2, members)
    deep = radius * 2.0 / 2.0**max_zoom
    cells = points.select("x", "y", F.floor(F.col("x") / deep).alias("cx"), F.floor(F.col("y") / deep).alias("cy"))
    sums = cells.groupBy("cx", "cy").agg(F.count("*").alias("count"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    up = sums.withColumn("z", F.explode(zooms))
    above = lambda c: F.expr(f"shiftright({c}, {max_zoom} - z)").alias(c)
    up = up.select("z", above("cx"), above("cy"), "count", "x", "y").groupBy("z", "cx", "cy").agg(*[F.sum(c).alias(c) for c in ("count", "x", "y")])
    return up.select("z", "cx", "cy", "count", (F.col("x") / F.col("count")).alias("x"), (F.col("y") / F.col("count")).alias("y"))


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(fid, label): the least id of each component of links (a, b), by rounds of least labels and jumps."""
    labels = kept(nodes.select("fid", F.col("fid").alias("label")))
    while True:
        around = links.join(labels.select(F.col("fid").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        new = labels.join(around, F.col("fid") == F.col("a"), "left").select("fid", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        heads = new.select(F.col("fid").alias("head"), F.col("new").alias("jump"))
        new = kept(new.join(heads, F.col("new") == F.col("head")).select("fid", "label", F.least("new", "jump").alias("new")))
        changed = new.filter("label <> new").limit(1).count()
        labels = new.select("fid", F.col("new").alias("label"))
        if not changed:
            return labels


#: Points of a cell of this side are within eps of each other; a little less than eps over the root of two.
CELLS_A_REACH = 1.4142136
#: Boxes with so few pairs of points are compared point by point.
FEW_PAIRS = 64
#: Boxes shrink by this factor a round, as a power of two.
SHRINK = 2
MAX_LEVEL = 16


def _at(c: str, level: int, side: float) -> Column:
    return F.floor(F.col(c) * F.lit(2.0 ** (SHRINK * level) / side))


def _boxes(points: DataFrame, level: int, side: float, name: str) -> DataFrame:
    """The boxes of points (key, x, y) in cells of a level, with their extents: columns of a struct `name`."""
    box = F.struct("bx", "by", "n", "x0", "x1", "y0", "y1").alias(f"{name}_box")
    found = points.groupBy("key", _at("x", level, side).alias("bx"), _at("y", level, side).alias("by"))
    found = found.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return found.select(F.col("key").alias(name), F.shiftright("bx", SHRINK).alias(f"{name}_up_x"), F.shiftright("by", SHRINK).alias(f"{name}_up_y"), box)


def _apart(a: Column, b: Column) -> tuple[Column, Column]:
    """Squares of the least and the largest distance between points of two boxes."""
    zero = F.lit(0.0)
    near = lambda lo, hi: F.greatest(zero, b[lo] - a[hi], a[lo] - b[hi])
    far = lambda lo, hi: F.greatest(b[hi] - a[lo], a[hi] - b[lo])
    dx, dy, wx, wy = near("x0", "x1"), near("y0", "y1"), far("x0", "x1"), far("y0", "y1")
    return dx * dx + dy * dy, wx * wx + wy * wy


def _touching(left: DataFrame, right: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """The pairs (a, b) of keys with a point of left and a point of right within eps, for points (key, x, y).

    Boxes around the points are compared, and shrunk round by round where they leave it open; a
    pair of keys is done with the first boxes that are within reach as a whole.
    """
    side, reach = eps / CELLS_A_REACH, F.lit(eps * eps)
    done, level = [], 0
    open_ = pairs.select("a", "b")
    up: list[str] = []
    while True:
        boxes = open_.join(_boxes(left, level, side, "a"), ["a", *[c for c in up if c.startswith("a")]])
        boxes = boxes.join(_boxes(right, level, side, "b"), ["b", *[c for c in up if c.startswith("b")]])
        near, far = _apart(F.col("a_box"), F.col("b_box"))
        small = (F.col("a_box.n") * F.col("b_box.n") <= FEW_PAIRS) | F.lit(level >= MAX_LEVEL)
        state = F.when(far <= reach, 0).when(small, 1).otherwise(2)
        tried = kept(boxes.filter(near <= reach).select("a", "b", *[F.col(f"{k}_box.b{c}").alias(f"{k}_up_{c}") for k in "ab" for c in "xy"], state.alias("state")))
        points = lambda df, k: df.select(F.col("key").alias(k), _at("x", level, side).alias(f"{k}_up_x"), _at("y", level, side).alias(f"{k}_up_y"), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))  # noqa: E731, B023
        exact = tried.filter("state = 1").join(points(left, "a"), ["a", "a_up_x", "a_up_y"]).join(points(right, "b"), ["b", "b_up_x", "b_up_y"])
        dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
        done.append(kept(tried.filter("state = 0").select("a", "b").unionByName(exact.filter(dx * dx + dy * dy <= reach).select("a", "b")).distinct()))
        open_ = tried.filter("state = 2").drop("state").join(done[-1], ["a", "b"], "left_anti")
        if not open_.limit(1).count():
            break
        level, up = level + 1, ["a_up_x", "a_up_y", "b_up_x", "b_up_y"]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.distinct()


def _reached(queries: DataFrame, points: DataFrame, pairs: DataFrame, eps: float, enough: int) -> DataFrame:
    """The queries (fid, x, y) with `enough` points (key, x, y) within eps, themselves counted; pairs (fid, key) tell where to look.

    Boxes of points that are within reach as a whole count at once; others shrink, as long as the
    query has not enough.
    """
    side, reach = eps / CELLS_A_REACH, F.lit(eps * eps)
    spot = F.struct(F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1"))
    asked = queries.select("fid", spot.alias("spot"))
    open_, counts, level, up = pairs.join(asked, "fid").select("fid", "spot", F.col("key").alias("b")), None, 0, []
    while True:
        boxes = open_.join(_boxes(points, level, side, "b"), ["b", *up])
        near, far = _apart(F.col("spot"), F.col("b_box"))
        small = (F.col("b_box.n") <= FEW_PAIRS) | F.lit(level >= MAX_LEVEL)
        tried = kept(boxes.filter(near <= reach).select("fid", "spot", "b", F.col("b_box.bx").alias("b_up_x"), F.col("b_box.by").alias("b_up_y"), F.when(far <= reach, F.col("b_box.n")).alias("n"), small.alias("small")))
        exact = tried.filter("n IS NULL AND small").join(points.select(F.col("key").alias("b"), _at("x", level, side).alias("b_up_x"), _at("y", level, side).alias("b_up_y"), "x", "y"), ["b", "b_up_x", "b_up_y"])
        dx, dy = F.col("spot.x0") - F.col("x"), F.col("spot.y0") - F.col("y")
        sure = tried.filter("n IS NOT NULL").select("fid", "n").unionByName(exact.filter(dx * dx + dy * dy <= reach).select("fid", F.lit(1).cast("long").alias("n")))
        sure = sure if counts is None else sure.unionByName(counts)
        counts = kept(sure.groupBy("fid").agg(F.sum("n").alias("n")))
        full = counts.filter(F.col("n") >= enough).select("fid")
        open_ = tried.filter("n IS NULL AND NOT small").select("fid", "spot", "b", "b_up_x", "b_up_y").join(full, "fid", "left_anti")
        if not open_.limit(1).count():
            return full
        level, up = level + 1, ["b_up_x", "b_up_y"]


def _around(cells: DataFrame) -> DataFrame:
    """cells (key) with each cell (near) whose points can be within reach, itself left out."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0)])
    near = F.struct((F.col("key.cx") + F.col("step.i")).alias("cx"), (F.col("key.cy") + F.col("step.j")).alias("cy"))
    return cells.withColumn("step", F.explode(steps)).withColumn("near", near).drop("step")


def dbscan(points: DataFrame, eps: float = 0.05, min_points: int = 2) -> DataFrame:
    """(fid, cluster, core) for points (fid, x, y): clusters numbered from 0 by their least core id, null for noise.

    A core has at least min_points others within eps; a border point joins the earliest cluster
    that reaches it. Points fall into cells so small that those of one cell are neighbours, so a
    full cell's points are cores without a look, a cell belongs to one cluster, and clusters are
    components of cells. What is near is found by boxes that shrink, never by pairs of all points.
    Points without a place are noise.
    """
    side = eps / CELLS_A_REACH
    key = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct(_at("x", 0, side).alias("cx"), _at("y", 0, side).alias("cy")))
    placed = kept(points.select("fid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("key", key))
    there = placed.filter("key IS NOT NULL")
    sizes = kept(there.groupBy("key").agg(F.count("*").alias("n")))
    full, thin = sizes.filter(F.col("n") > min_points).select("key"), sizes.filter(F.col("n") <= min_points).select("key")
    # thin cells hold min_points each at most, so these tables stay in proportion to the points
    asked = there.join(thin, "key", "left_semi")
    seen = asked.join(_around(thin), "key").select("fid", F.col("near").alias("key")).join(sizes.select("key"), "key")
    own = asked.select("fid", "key")
    found = _reached(asked, there.select("key", "x", "y"), kept(seen.unionByName(own.select(seen.columns))), eps, min_points + 1)
    cores = kept(there.join(full, "key", "left_semi").unionByName(asked.join(found, "fid", "left_semi").select(there.columns)))
    core_cells = kept(cores.groupBy("key").agg(F.min("fid").alias("node")))
    one_way = _around(core_cells.select("key")).filter("key < near").join(core_cells.select(F.col("key").alias("near")), "near").select(F.col("key").alias("a"), F.col("near").alias("b"))
    spots = cores.select("key", "x", "y")
    links = _touching(spots, spots, kept(one_way), eps)
    node = lambda k: core_cells.select(F.col("key").alias(k), F.col("node").alias(f"{k}_node"))
    links = links.join(node("a"), "a").join(node("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    labels = _labels(core_cells.select(F.col("node").alias("fid")), kept(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))))
    numbers = numbered(labels.select("label").distinct(), "label", name="cluster")
    cell_cluster = kept(core_cells.join(labels, F.col("node") == F.col("fid")).join(numbers, "label").select("key", "cluster"))
    rest = there.join(thin, "key", "left_semi").join(cores.select("fid"), "fid", "left_anti")
    edge_cells = rest.select("fid", "key").unionByName(_around(rest.select("fid", "key")).select("fid", F.col("near").alias("key"))).join(cell_cluster, "key")
    edges = edge_cells.select(F.struct(F.col("fid")).alias("a"), F.col("key").alias("b"))
    held = _touching(rest.select(F.struct("fid").alias("key"), "x", "y"), spots, kept(edges), eps)
    border = held.join(cell_cluster.select(F.col("key").alias("b"), "cluster"), "b").groupBy(F.col("a.fid").alias("fid")).agg(F.min("cluster").alias("near"))
    core = cores.join(cell_cluster, "key").select("fid", "cluster")
    out = points.select("fid").join(core, "fid", "left").join(border, "fid", "left")
    return out.select("fid", F.coalesce("cluster", "near").alias("cluster"), F.col("cluster").isNotNull().alias("core"))


def dbscan_clusters(points: DataFrame, eps: float = 0.05, min_points: int = 2) -> DataFrame:
    """(cluster, count, x, y): centroids of the clusters, then every noise point as one of its own with a null number."""
    found = points.join(dbscan(points, eps, min_points), "fid")
    full = found.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("count"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return full.unionByName(found.filter("cluster IS NULL").select("cluster", F.lit(1).cast("long").alias("count"), "x", "y"))
