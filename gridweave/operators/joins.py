"""Spatial and graph joins.

A small side, by its counted rows, is broadcast; a larger one is matched by grid cells, so that
no join multiplies both sides whatever their size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.geo import distance, inside_segments, rings_to_segments
from gridweave.functions.text import present
from gridweave.operators.ordering import if_few, ordinal
from gridweave.workspace import Workspace

#: Rows up to which a side of a spatial join is broadcast.
BROADCAST_ROWS = 5_000
#: Rows of a tile's left side, of sixteen times a block; pairs that a task compares, about; targets of a task in the search of nearest sources.
TILE_ROWS, TASK_PAIRS, TASK_TARGETS = 32_768, 50_000_000, 25_000


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


#: Sources of a leaf and children of a node, in the tree that nearest neighbours are searched in.
LEAF_ROWS, FANOUT = 8, 8


def _z_order(x, y, low: tuple[float, float], side: float) -> Column:
    """Number of a point's place along the Z-order curve over a square, 26 bits an axis."""

    def spread(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    step = side / ((1 << 26) - 1)
    x, y = (F.least(F.greatest(F.floor((F.col(c) - F.lit(o)) / F.lit(step)), F.lit(0)), F.lit((1 << 26) - 1)).cast("long") for c, o in ((x, low[0]), (y, low[1])))
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def search_tree(sources: DataFrame, ws: Workspace) -> tuple[DataFrame, list[DataFrame]]:
    """(sources with their leaf, levels of nodes from the root down) of rows (s_id, s_ord, sx, sy).

    Sources are numbered along the Z-order curve and cut into leaves of equal counts, so a city has many small
    leaves and a far outlier shares one; nodes (node, up, x0, y0, x1, y1) have the boxes of what they hold.
    """
    n, x0, x1, y0, y1 = sources.agg(F.count(F.lit(1)), F.min("sx"), F.max("sx"), F.min("sy"), F.max("sy")).first()
    side = max(x1 - x0, y1 - y0, 1e-9) if n else 1.0
    z = sources.withColumn("_z", _z_order("sx", "sy", (x0 or 0.0, y0 or 0.0), side))
    z = ordinal(z, [F.col(c) for c in ("_z", "sx", "sy", "s_ord", "s_id")], ws, "_n") if n > LEAF_ROWS else z.withColumn("_n", F.lit(0))
    rows = ws.save(z.withColumn("leaf", F.floor(F.col("_n") / LEAF_ROWS).cast("long")).drop("_z", "_n"))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    up = F.floor(F.col("node") / FANOUT).cast("long").alias("up")
    nodes = rows.select(F.col("leaf").alias("node"), F.col("sx").alias("x0"), F.col("sy").alias("y0"), F.col("sx").alias("x1"), F.col("sy").alias("y1")).groupBy("node").agg(*box)
    levels, count = [ws.save(nodes.select("node", up, "x0", "y0", "x1", "y1"))], -(-n // LEAF_ROWS)
    while count > 1:
        above = levels[-1].groupBy(F.col("up").alias("node")).agg(*box)
        levels.append(ws.save(above.select("node", up, "x0", "y0", "x1", "y1")))
        count = -(-count // FANOUT)
    return rows, levels[::-1]


def nearest_leaves(targets: DataFrame, levels: list[DataFrame], n_sources: int, broadcast_rows: int, ws: Workspace, tasks: int = 8) -> DataFrame:
    """(t_id, tx, ty, leaf): the leaves that may hold a target's nearest source, by descent from the root.

    On each level a target follows the nodes whose box is no farther than the nearest source can be: every side
    of a box has a source on it, so the nearer of two of them bounds the distance. Targets stay where they are
    dealt while levels are small enough to broadcast; below that targets and nodes meet by the node's number.
    They are dealt to ``tasks`` parts each time, since fewer parts by bytes would each hold more as targets grow.
    """
    front = targets.withColumns({"node": F.lit(0).cast("long"), "ub": F.lit(float("inf"))}).repartition(tasks, "t_id")
    for i, nodes in enumerate(levels):
        height = len(levels) - 1 - i
        own = nodes.select(F.col("node").alias("_node"), F.col("up").alias("_up"), "x0", "y0", "x1", "y1")
        few = n_sources <= broadcast_rows * LEAF_ROWS * FANOUT**height
        key = "_up" if i else "_node"
        if few:
            met = front.join(F.broadcast(own), F.col("node") == F.col(key))
        else:
            met = front.repartition(tasks, "node").join(own.repartition(tasks, key), F.col("node") == F.col(key))
        dx = F.greatest(F.col("x0") - F.col("tx"), F.col("tx") - F.col("x1"), F.lit(0.0))
        dy = F.greatest(F.col("y0") - F.col("ty"), F.col("ty") - F.col("y1"), F.lit(0.0))
        ends = {c: (F.abs(F.col(t) - F.col(f"{c}0")), F.abs(F.col(t) - F.col(f"{c}1"))) for c, t in (("x", "tx"), ("y", "ty"))}
        near, far = ({c: f(*e) for c, e in ends.items()} for f in (F.least, F.greatest))
        sure = F.sqrt(F.least(near["x"] * near["x"] + far["y"] * far["y"], near["y"] * near["y"] + far["x"] * far["x"]))
        within = F.col("_low") <= F.col("ub") * (1 + 1e-12)
        met = met.select("t_id", "tx", "ty", F.col("_node").alias("node"), "ub", F.sqrt(dx * dx + dy * dy).alias("_low"), sure.alias("_sure"))
        met = met if few else met.where(within).repartition(tasks, "t_id")  # what is too far already needn't be sent on
        met = met.withColumn("ub", F.least("ub", F.min("_sure").over(Window.partitionBy("t_id"))))
        front = met.where(within).select("t_id", "tx", "ty", "node", "ub")
        front = front if few else ws.save(front)
    return front.select("t_id", "tx", "ty", F.col("node").alias("leaf"))


def nearest(targets: DataFrame, sources: DataFrame, target_id: str, source_id: str, source_order: str | None = None, xy=("x", "y"), broadcast_rows: int = BROADCAST_ROWS, ws: Workspace | None = None) -> DataFrame:
    """The nearest source of every target: (target_id, source_id, metres), ties to the first source.

    Both sides carry projected coordinates; rows without them or without an id have no part. A target
    that is in several places takes the source nearest to any. Sources are searched in a tree of leaves
    of equal counts along a Z-order curve, so a target sees a few leaves however sources are spread.
    """
    x, y = xy
    order = source_order or source_id
    known = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    t = targets.select(F.col(target_id).alias("t_id"), F.col(x).cast("double").alias("tx"), F.col(y).cast("double").alias("ty")).where(F.col("t_id").isNotNull() & known("tx", "ty")).distinct()
    s = sources.select(F.col(source_id).alias("s_id"), F.col(order).alias("s_ord"), F.col(x).cast("double").alias("sx"), F.col(y).cast("double").alias("sy")).where(known("sx", "sy"))
    ws = ws or Workspace(t.sparkSession)
    s = ws.save(s)
    n = s.count()
    rows, levels = search_tree(s, ws)
    t = ws.save(t)
    tasks = max(-(-t.count() // TASK_TARGETS), 8)
    leaves = nearest_leaves(t, levels, n, broadcast_rows, ws, tasks)
    # a leaf is one row, so a target's sources are compared where they meet and one a leaf is left
    packed = rows.groupBy("leaf").agg(F.collect_list(F.struct("sx", "sy", "s_ord", "s_id")).alias("_in"))
    if n <= broadcast_rows:
        met = leaves.join(F.broadcast(packed), "leaf")
    else:
        met = leaves.repartition(tasks, "leaf").join(packed.repartition(tasks, "leaf"), "leaf")
    best = F.array_min(F.transform("_in", lambda s: F.struct(distance("tx", "ty", s["sx"], s["sy"]).alias("d"), s["s_ord"].alias("o"), s["s_id"].alias("s"))))
    met = met.select("t_id", best.alias("b"))
    found = (met if n <= broadcast_rows else met.repartition(tasks, "t_id")).groupBy("t_id").agg(F.min("b").alias("b"))
    return found.select(F.col("t_id").alias(target_id), F.col("b.s").alias(source_id), F.col("b.d").alias("metres"))


def within_radius(left: DataFrame, right: DataFrame, radius: float, xy=("x", "y"), strict: bool = False, ws: Workspace | None = None) -> DataFrame:
    """Pairs of rows within ``radius``, columns prefixed l_ and r_, with ``metres``.

    Cells are half a radius wide. The right side's rows lie packed in blocks, one row a block, which are dealt to their cell
    and the 24 around it, so the join is by equal cells and a row of the left goes through arrays. What is crowded
    is cut to tiles of ``TILE_ROWS`` of the left and half as many of the right at most, and tiles are spread over tasks by the pairs in them, so a
    radius as wide as all places is the work of many tasks; little is sent, since a tile has many rows of both.
    """
    x, y = xy
    ws = ws or Workspace(left.sparkSession)
    side = radius / 2.0 * (1 + 1e-9) or 1.0  # a trifle wider, so that rounding sends no pair three cells apart
    at = lambda c: F.floor(F.col(c) / F.lit(side)).cast("long")
    finite = " and ".join(f"abs({c}) < double('infinity')" for c in xy)
    placed = lambda df, p: ws.save(_prefixed(df.where(finite), p).withColumns({"cx": at(f"{p}{x}"), "cy": at(f"{p}{y}"), f"_{p}n": F.monotonically_increasing_id()}))
    a, b = placed(left, "l_"), placed(right, "r_")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])).alias("_k")
    dealt = lambda df: df.withColumn("_k", around).withColumns({"cx": F.col("cx") + F.col("_k.i"), "cy": F.col("cy") + F.col("_k.j")}).drop("_k")
    own = a.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("_a"))
    there = b.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("_n"))
    parts = lambda c, most: F.ceil(F.col(c) / F.lit(most)).cast("int")
    blocks = b.join(there, ["cx", "cy"]).withColumn("_q", F.pmod("_r_n", parts("_n", max(TILE_ROWS // 16, 1))))
    blocks = ws.save(blocks.groupBy("cx", "cy", "_q").agg(F.collect_list(F.struct(*[c for c in b.columns if c not in ("cx", "cy", "_r_n")])).alias("_in")))
    sums = dealt(there).groupBy("cx", "cy").agg(F.sum("_n").alias("_b"))
    cells = ws.save(own.join(sums, ["cx", "cy"]).select("cx", "cy", parts("_a", TILE_ROWS).alias("_na"), parts("_b", max(TILE_ROWS // 2, 1)).alias("_nb"), (F.col("_a") * F.col("_b")).alias("_pairs")))
    pairs = cells.agg(F.coalesce(F.sum("_pairs"), F.lit(0))).first()[0]
    tasks = min(max(-(-pairs // TASK_PAIRS), 8), 20_000)
    cells, tile = if_few(cells.drop("_pairs")), ["cx", "cy", "_i", "_j"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = a.join(cells, ["cx", "cy"]).withColumns({"_i": F.pmod("_l_n", "_na").cast("int"), "_j": every("_nb")}).drop("_na", "_nb", "_l_n").repartition(tasks, *tile)
    b = dealt(blocks.withColumn("_h", F.xxhash64("cx", "cy", "_q"))).join(cells, ["cx", "cy"]).withColumns({"_j": F.pmod("_h", "_nb").cast("int"), "_i": every("_na")}).drop("_na", "_nb", "_h", "_q").repartition(tasks, *tile)
    met = a.join(b.hint("merge"), tile).drop(*tile).select("*", F.inline("_in")).drop("_in").withColumn("metres", distance(f"l_{x}", f"l_{y}", f"r_{x}", f"r_{y}"))
    return met.where(F.col("metres") < radius if strict else F.col("metres") <= radius)


def farther_than(left: DataFrame, right: DataFrame, radius: float, key: str, xy=("x", "y"), ws: Workspace | None = None) -> DataFrame:
    """Rows of ``left`` without a row of ``right`` nearer than ``radius``; ``key`` tells rows apart.

    Only the nearest row is looked for, so the work doesn't grow with the pairs that are near.
    """
    placed = lambda df: df.where(" and ".join(f"abs({c}) < double('infinity')" for c in xy))
    there = placed(right.select(*xy)).distinct().withColumn("_s", F.lit(0))
    close = nearest(placed(left.select(key, *xy)), there, key, "_s", xy=xy, ws=ws).where(F.col("metres") < radius).select(key)
    return left.join(close, key, "left_anti")


def _by_cells(points: DataFrame, boxes: DataFrame, x: str, y: str, step: float) -> DataFrame:
    """Points joined to the boxes (left, bottom, right, top) of the grid cells that they lie in.

    A box is dealt to cells of its own size class, ``step`` times a power of two, so even the largest
    lies in four cells at most; points ask each class that there is.
    """
    width = F.greatest(F.col("right") - F.col("left"), F.col("top") - F.col("bottom"), F.lit(float(step)))
    boxes = boxes.withColumn("_class", F.ceil(F.log2(width / F.lit(float(step)))).cast("int"))
    classes = [r[0] for r in boxes.select("_class").where("_class is not null").distinct().collect()]  # as many as doublings
    at = lambda c: F.floor(F.col(c) / (F.pow(F.lit(2.0), "_class") * F.lit(float(step)))).cast("long")
    boxes = boxes.withColumn("cx", F.explode(F.sequence(at("left"), at("right")))).withColumn("cy", F.explode(F.sequence(at("bottom"), at("top"))))
    asks = points.withColumn("_class", F.explode(F.array(*[F.lit(c) for c in classes]).cast("array<int>"))).withColumns({"cx": at(x), "cy": at(y)})
    return asks.join(boxes, ["_class", "cx", "cy"]).drop("_class", "cx", "cy")


def first_box(points: DataFrame, boxes: DataFrame, key: str, box_id: str = "division", xy=("x", "y"), step: float | None = None) -> DataFrame:
    """(key, box_id): the least numbered box with the point, edges included, or -1.

    Boxes have left, bottom, right and top. Few boxes are broadcast; many are dealt to grid
    cells of ``step``, by default their mean width.
    """
    x, y = xy
    b = boxes.select(F.col(box_id).alias("_box"), "left", "bottom", "right", "top")
    p = points.select(key, x, y)
    inside = F.col(x).between(F.col("left"), F.col("right")) & F.col(y).between(F.col("bottom"), F.col("top"))
    if b.count() <= BROADCAST_ROWS:
        joined = p.join(F.broadcast(b), inside, "left")
    else:
        step = step or b.agg(F.avg(F.col("right") - F.col("left"))).first()[0]
        joined = _by_cells(p, b, x, y, step or 1.0).where(inside)
        joined = p.select(key).join(joined.select(key, "_box"), key, "left")
    return joined.groupBy(key).agg(F.coalesce(F.min("_box"), F.lit(-1)).alias(box_id))


def inside_any_polygon(points: DataFrame, polygons: DataFrame, key: str, rings: str = "rings", xy=("x", "y"), flag: str = "inside") -> DataFrame:
    """Points with a flag: strictly inside at least one polygon by the even-odd rule.

    Polygons without geometry are left out; their boxes are compared first. Few are broadcast,
    more meet points by cells of the mean box.
    """
    x, y = xy
    seg = polygons.where(F.col(rings).isNotNull()).select(rings_to_segments(rings).alias("segments"))
    ends = lambda f, a, b: f(F.transform("segments", lambda s: F.greatest(s[a], s[b]) if f is F.array_max else F.least(s[a], s[b])))
    seg = seg.select("segments", ends(F.array_min, "x1", "x2").alias("left"), ends(F.array_min, "y1", "y2").alias("bottom"), ends(F.array_max, "x1", "x2").alias("right"), ends(F.array_max, "y1", "y2").alias("top"))
    p = points.select(key, x, y)
    boxed = F.col(x).between(F.col("left"), F.col("right")) & F.col(y).between(F.col("bottom"), F.col("top"))
    n, edges, width = seg.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("segments")), F.lit(0)), F.avg(F.greatest(F.col("right") - F.col("left"), F.col("top") - F.col("bottom")))).first()
    if edges <= 20 * BROADCAST_ROWS:
        hits = p.join(F.broadcast(seg), boxed)
    else:
        hits = _by_cells(p, seg, x, y, width or 1.0).where(boxed)
    found = hits.where(inside_segments(x, y, "segments")).select(key).distinct().withColumn(flag, F.lit(True))
    return points.join(found, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def lookup_last(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, order: str, columns: Sequence[str]) -> DataFrame:
    """Left join where the last row of the right side with a key gives its columns."""
    table = right.groupBy(right_key.alias("_key")).agg(F.max_by(F.struct(*columns), order).alias("_v"))
    return left.withColumn("_key", left_key).join(table, "_key", "left").select(*[left[c] for c in left.columns], *[F.col("_v")[c].alias(c) for c in columns])


def endpoints_missing(lines: DataFrame, names: DataFrame, ends: list[str], name: str, order: str) -> DataFrame:
    """(name, ord): line ends, upper-cased, that aren't among the names, by first appearance."""
    ends_long = F.explode(F.array(*[F.struct(F.upper(c).alias("name"), F.struct(F.col(order).alias("o"), F.lit(i).alias("i")).alias("ord")) for i, c in enumerate(ends)])).alias("e")
    found = lines.select(ends_long).select("e.*").where("name is not null")
    known = names.select(F.upper(F.trim(name)).alias("name")).distinct()
    return found.join(known, "name", "left_anti").groupBy("name").agg(F.min("ord").alias("ord"))


def closed_edges(edges: DataFrame, nodes: DataFrame, node_id: str = "node_id") -> DataFrame:
    """Edges whose ends are both nodes and differ."""
    ids = nodes.select(F.col(node_id).alias("_n")).distinct()
    out = edges.where("u <> v").join(ids, edges["u"] == ids["_n"], "left_semi")
    return out.join(ids, out["v"] == ids["_n"], "left_semi")


def with_ends(edges: DataFrame, nodes: DataFrame, columns: Sequence[str], node_id: str = "node_id", how: str = "left") -> DataFrame:
    """Edges with their nodes' columns, prefixed u_ and v_."""
    out = edges
    for end in ("u", "v"):
        own = nodes.select(F.col(node_id).alias(f"_{end}"), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        out = out.join(own, out[end] == own[f"_{end}"], how).drop(f"_{end}")
    return out


def located(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows with a place that is neither null nor zero."""
    return df.where(present(lat) & present(lon))
