"""Valid polygons from any rings, as joins over their segments.

A polygon covers what its rings enclose an odd number of times. Segments are split where they
meet, pieces that lie on one another in pairs go, and what remains is the border: each piece
has the inside on one side. Pieces are turned so that it lies on their left, follow one
another around the corners of the inside, and so make rings that neither cross nor touch themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.geo import inside_segments, rings_to_segments
from gridweave.workspace import Workspace

#: Decimals of the corners that come out; points nearer than that are one.
DIGITS = 9
_NEAR = 1e-9
#: Points of the polygons that are made valid in one round, about.
ROUND_POINTS = 1_000_000
#: Segments up to which a polygon is compared within its row; segments of a task, about, of such polygons.
ROW_SEGMENTS, TASK_SEGMENTS = 256, 50_000


def _cells(df: DataFrame, p: str, size: Column) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    return df.withColumn("_cx", F.explode(F.sequence(at(f"{p}left"), at(f"{p}right")))).withColumn("_cy", F.explode(F.sequence(at(f"{p}bottom"), at(f"{p}top"))))


def box_pairs(small: DataFrame, large: DataFrame, key: str) -> DataFrame:
    """Rows of two tables with an equal ``key`` whose boxes meet and whose second box isn't of a lesser size class.

    Columns of the second are prefixed b_; boxes are left, bottom, right and top, and ``_class`` is the power of two
    of their larger side. A box is dealt to the cells of its own class, four at most, and asked for in those of each
    class that there is and isn't less, so neither long nor crowded boxes meet more than they must. A pair counts
    in the cell of the least corner of what the two share.
    """
    side = F.greatest(F.col("right") - F.col("left"), F.col("top") - F.col("bottom"), F.lit(1e-6))
    classed = lambda df: df.withColumn("_class", F.ceil(F.log2(side)).cast("int"))
    a, b = classed(small), classed(large)
    classes = [r[0] for r in b.select("_class").where("_class is not null").distinct().collect()]  # as many as doublings
    b = b.select(key, *[F.col(c).alias(f"b_{c}") for c in b.columns if c != key])
    b = _cells(b, "b_", F.pow(F.lit(2.0), "b__class"))
    a = a.withColumn("b__class", F.explode(F.array(*[F.lit(c) for c in classes]).cast("array<int>"))).where("b__class >= _class")
    a = _cells(a, "", F.pow(F.lit(2.0), "b__class"))
    met = a.join(b, [key, "b__class", "_cx", "_cy"])
    size = F.pow(F.lit(2.0), "b__class")
    first = (F.floor(F.greatest("left", "b_left") / size) == F.col("_cx")) & (F.floor(F.greatest("bottom", "b_bottom") / size) == F.col("_cy"))
    overlap = (F.col("left") <= F.col("b_right")) & (F.col("b_left") <= F.col("right")) & (F.col("bottom") <= F.col("b_top")) & (F.col("b_bottom") <= F.col("top"))
    return met.where(overlap & first).drop("_cx", "_cy")


def segments(polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(key, x1, y1, x2, y2) of all rings; points with a null are left out, rings close themselves."""
    whole = F.transform(F.filter(F.col(rings), lambda r: r.isNotNull()), lambda r: F.filter(r, lambda c: F.coalesce(F.get(c, F.lit(0)).isNotNull() & F.get(c, F.lit(1)).isNotNull(), F.lit(False))))
    rounded = F.transform(whole, lambda r: F.transform(r, lambda c: F.transform(F.slice(c, 1, 2), lambda v: F.round(v.cast("double"), DIGITS))))
    out = polygons.select(key, F.explode(rings_to_segments(rounded)).alias("_s")).select(key, "_s.*")
    return out.where("x1 <> x2 or y1 <> y2")


def _with_box(s: DataFrame) -> DataFrame:
    return s.withColumns({"left": F.least("x1", "x2"), "right": F.greatest("x1", "x2"), "bottom": F.least("y1", "y2"), "top": F.greatest("y1", "y2")})


def noded(segs: DataFrame, key: str, ws: Workspace) -> DataFrame:
    """The segments split wherever they meet: (key, x1, y1, x2, y2), smaller end first, once for each time that they lie there."""
    s = ws.save(_with_box(segs.withColumn("sid", F.monotonically_increasing_id())))
    p = box_pairs(s, s, key).where("_class < b__class or sid < b_sid")
    c = F.col
    dx, dy, ex, ey = c("x2") - c("x1"), c("y2") - c("y1"), c("b_x2") - c("b_x1"), c("b_y2") - c("b_y1")
    gx, gy = c("b_x1") - c("x1"), c("b_y1") - c("y1")
    p = p.withColumns({"det": dx * ey - dy * ex, "off": gx * dy - gy * dx, "len": F.sqrt(dx * dx + dy * dy), "b_len": F.sqrt(ex * ex + ey * ey)})
    flat = F.abs("det") <= _NEAR * c("len") * c("b_len")
    p = p.withColumns({"t": F.when(~flat, (gx * ey - gy * ex) / c("det")), "u": F.when(~flat, (gx * dy - gy * dx) / c("det"))})
    point = lambda x, y: F.struct(F.round(x, DIGITS).alias("x"), F.round(y, DIGITS).alias("y"))
    # an end that lies on the other segment is the point itself, so both have the very same
    ends = [point(c("x1"), c("y1")), point(c("x2"), c("y2")), point(c("b_x1"), c("b_y1")), point(c("b_x2"), c("b_y2"))]
    near = lambda v, w, size: F.abs(v - F.lit(w)) * size <= 10**-DIGITS * 2
    at = F.when(near(c("t"), 0.0, c("len")), ends[0]).when(near(c("t"), 1.0, c("len")), ends[1]).when(near(c("u"), 0.0, c("b_len")), ends[2]).when(near(c("u"), 1.0, c("b_len")), ends[3])
    at = at.otherwise(point(c("x1") + c("t") * dx, c("y1") + c("t") * dy))
    met = c("t").between(-_NEAR, 1 + _NEAR) & c("u").between(-_NEAR, 1 + _NEAR)
    on_line = flat & (F.abs("off") <= 10**-DIGITS * 2 * c("len"))
    cuts = F.when(met, F.array(at)).when(on_line, F.array(*ends)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    p = p.select(key, "sid", "b_sid", F.explode(cuts).alias("c")).select(key, F.explode(F.array("sid", "b_sid")).alias("sid"), "c.x", "c.y")
    own = s.select(key, "sid", F.explode(F.array(F.struct(c("x1").alias("x"), c("y1").alias("y")), F.struct(c("x2").alias("x"), c("y2").alias("y")))).alias("c")).select(key, "sid", "c.x", "c.y")
    line = s.select("sid", "x1", "y1", "x2", "y2")
    points = p.unionByName(own).join(line, "sid")
    along = ((c("x") - c("x1")) * dx + (c("y") - c("y1")) * dy) / (dx * dx + dy * dy)
    points = points.withColumn("t", along).where((c("t") >= -_NEAR) & (c("t") <= 1 + _NEAR)).select(key, "sid", "t", "x", "y").distinct()
    w = Window.partitionBy(key, "sid").orderBy("t", "x", "y")
    pieces = points.select(key, c("x").alias("xa"), c("y").alias("ya"), F.lead("x").over(w).alias("xb"), F.lead("y").over(w).alias("yb")).where("xb is not null and (xa <> xb or ya <> yb)")
    swap = (c("xa") > c("xb")) | ((c("xa") == c("xb")) & (c("ya") > c("yb")))
    pick = lambda a, b: F.when(swap, c(b)).otherwise(c(a))
    return pieces.select(key, pick("xa", "xb").alias("x1"), pick("ya", "yb").alias("y1"), pick("xb", "xa").alias("x2"), pick("yb", "ya").alias("y2"))


def _turned(border: DataFrame, key: str, ws: Workspace) -> DataFrame:
    """Border pieces (eid, u, v) with the inside on the left, told by rays from their midpoints.

    Steep pieces send a ray to the right, flat ones one upwards; an odd number of other pieces
    on its way has the side that it leaves from inside.
    """
    c = F.col
    e = border.withColumn("steep", F.abs(c("x2") - c("x1")) < F.abs(c("y2") - c("y1")))
    found = []
    for steep, a1, a2, b1, b2 in ((True, "x1", "x2", "y1", "y2"), (False, "y1", "y2", "x1", "x2")):
        mid, at = (c(a1) + c(a2)) / 2, (c(b1) + c(b2)) / 2
        rays = e.where(c("steep") == steep).select(key, "eid", mid.alias("m"), at.alias("at")).withColumns({"left": F.lit(0.0), "right": F.lit(0.0), "bottom": c("at"), "top": c("at")})
        walls = border.select(key, "eid", c(a1).alias("p1"), c(a2).alias("p2"), c(b1).alias("q1"), c(b2).alias("q2")).where("q1 <> q2").withColumns({"left": F.lit(0.0), "right": F.lit(0.0), "bottom": F.least("q1", "q2"), "top": F.greatest("q1", "q2")})
        hit = box_pairs(rays, walls, key).where("eid <> b_eid and (b_q1 > at) <> (b_q2 > at)")
        hit = hit.where(c("b_p1") + (c("at") - c("b_q1")) * (c("b_p2") - c("b_p1")) / (c("b_q2") - c("b_q1")) > c("m"))
        found.append(e.where(c("steep") == steep).join(hit.groupBy("eid").agg(F.count(F.lit(1)).alias("n")), "eid", "left"))
    e = found[0].unionByName(found[1])
    ray_inside = F.coalesce("n", F.lit(0)) % 2 == 1
    # with the smaller end first, a steep piece that rises has the ray on its right; a flat one runs to the right and has it on its left
    left_inside = F.when(c("steep"), F.when(c("y2") > c("y1"), ~ray_inside).otherwise(ray_inside)).otherwise(ray_inside)
    p, q = F.struct(c("x1").alias("x"), c("y1").alias("y")), F.struct(c("x2").alias("x"), c("y2").alias("y"))
    return ws.save(e.select(key, "eid", F.when(left_inside, p).otherwise(q).alias("u"), F.when(left_inside, q).otherwise(p).alias("v")))


def _rings(e: DataFrame, key: str, ws: Workspace) -> DataFrame:
    """(key, ring, pos, x, y): pieces in the order of their rings, by pointer jumping."""
    c = F.col
    # around a corner, what comes in goes on along the next piece clockwise from where it came
    angle = lambda a, b: F.atan2(b["y"] - a["y"], b["x"] - a["x"])
    spokes = e.select(key, c("v").alias("hub"), angle(c("v"), c("u")).alias("angle"), c("eid").alias("into"), F.lit(None).cast("long").alias("out"))
    spokes = spokes.unionByName(e.select(key, c("u").alias("hub"), angle(c("u"), c("v")).alias("angle"), F.lit(None).cast("long").alias("into"), c("eid").alias("out")))
    by = Window.partitionBy(key, "hub").orderBy("angle")
    every = Window.partitionBy(key, "hub").orderBy("angle").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = ws.save(spokes.select("into", F.coalesce(F.lag("out").over(by), F.last("out").over(every)).alias("nxt")).where("into is not null and nxt is not null"))
    low = nxt.select(c("into").alias("eid"), c("nxt"), F.least("into", "nxt").alias("low"))
    while True:
        on = low.select(c("eid").alias("_e"), c("nxt").alias("_n"), c("low").alias("_l"))
        step = ws.save(low.join(on, low["nxt"] == on["_e"]).select("eid", c("_n").alias("nxt"), F.least("low", "_l").alias("low"), (c("_l") < c("low")).alias("moved")))
        ws.drop(low)
        low = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    ring = low.select("eid", c("low").alias("ring"))
    far = nxt.join(ring, nxt["into"] == ring["eid"]).select("eid", F.when(c("nxt") != c("ring"), c("nxt")).alias("nxt"), "ring", F.lit(1).cast("long").alias("far"))
    far = ws.save(far)
    while not far.where("nxt is not null").isEmpty():
        on = far.select(c("eid").alias("_e"), c("nxt").alias("_n"), c("far").alias("_f"))
        step = ws.save(far.join(on, far["nxt"] == on["_e"], "left").select("eid", c("_n").alias("nxt"), "ring", (c("far") + F.coalesce("_f", F.lit(0))).alias("far")))
        ws.drop(far)
        far = step
    placed = e.join(far, "eid").select(key, "ring", (-c("far")).alias("pos"), c("u.x").alias("x"), c("u.y").alias("y"), "eid")
    # a ring that comes to a point again is cut there, the innermost loops first
    while True:
        again = Window.partitionBy("ring", "x", "y").orderBy("pos")
        after = Window.partitionBy("ring").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
        rows = placed.withColumn("till", F.lead("pos").over(again)).withColumn("least", F.min("till").over(after))
        loops = ws.save(rows.where("till is not null and (least is null or least >= till)").select("ring", c("pos").alias("from"), "till", c("eid").alias("own")))
        if loops.isEmpty():
            return placed.drop("eid")
        inner = loops.select(c("ring").alias("_r"), "from", "till", "own")
        placed = placed.join(inner, (c("ring") == c("_r")) & (c("pos") >= c("from")) & (c("pos") < c("till")), "left")
        placed = ws.save(placed.withColumn("ring", F.when(c("own").isNotNull(), -c("own") - 1).otherwise(c("ring"))).drop("_r", "from", "till", "own"))


def valid_rings(polygons: DataFrame, key: str, rings: str = "rings", ws: Workspace | None = None) -> DataFrame:
    """(key, ring, points, area, shell): rings that neither cross nor touch themselves, and share points only singly.

    Together they cover, by the even-odd rule, what the rings given do. Shells run counter-clockwise with a positive
    area; holes run clockwise with a negative one and name the smallest shell around them as ``shell``. Rings needn't be
    closed; null rings, points with a null, repeated points and pieces that are run along and back vanish, so a
    polygon without area has no row. Rows that repeat a key are taken together. A polygon's own segments meet by
    cells, so its work grows with the segments that lie side by side. Coordinates are rounded to nine decimals.
    """
    ws = ws or Workspace(polygons.sparkSession)
    c = F.col
    pieces = noded(segments(polygons, key, rings), key, ws)
    border = pieces.groupBy(key, "x1", "y1", "x2", "y2").agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1").drop("odd")
    border = ws.save(border.withColumn("eid", F.monotonically_increasing_id()))
    placed = _rings(_turned(border, key, ws), key, ws)
    points = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda s: F.array(s["x"], s["y"]))  # a ring
    found = placed.groupBy(key, "ring").agg(points.alias("points"), F.min("x").alias("left"), F.min("y").alias("bottom"), F.max("x").alias("right"), F.max("y").alias("top"))
    n = F.size("points")
    cross = F.zip_with("points", F.concat(F.slice("points", 2, n), F.slice("points", 1, 1)), lambda a, b: (a[0] - c("left")) * (b[1] - c("bottom")) - (b[0] - c("left")) * (a[1] - c("bottom")))
    found = ws.save(found.withColumn("area", F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2))
    first = lambda i: (F.get(F.get("points", F.lit(0)), F.lit(i)) + F.get(F.get("points", F.lit(1)), F.lit(i))) / 2
    holes = found.where("area < 0").select(key, "ring", "left", "bottom", "right", "top", first(0).alias("px"), first(1).alias("py"))
    shells = found.where("area > 0").select(key, "ring", "left", "bottom", "right", "top", "area", "points")
    around = box_pairs(holes, shells, key).withColumn("segs", rings_to_segments(F.array("b_points"))).where(inside_segments("px", "py", "segs"))
    around = around.groupBy("ring").agg(F.min_by("b_ring", F.struct("b_area", "b_ring")).alias("shell"))
    return found.join(around, "ring", "left").select(key, "ring", "points", "area", F.coalesce("shell", "ring").alias("shell"))


def make_valid(polygons: DataFrame, key: str, rings: str = "rings", ws: Workspace | None = None) -> DataFrame:
    """(key, rings, parts, area): polygons as valid rings, one row a key that covers anything.

    ``parts`` has an array of rings for each shell, the shell first, as a multi-polygon is written; ``rings`` has all of them.
    Keys are taken in rounds of some ``ROUND_POINTS`` points, and what a round wrote on its way is deleted before the next,
    so the disk holds one round's tables and the results, however many polygons there are.
    """
    ws = ws or Workspace(polygons.sparkSession)
    own = ws.save(polygons.select(key, F.col(rings).alias("rings")))
    points = own.agg(F.coalesce(F.sum(F.aggregate("rings", F.lit(0).cast("long"), lambda s, r: s + F.greatest(F.coalesce(F.size(r), F.lit(0)), F.lit(0)))), F.lit(0))).first()[0]
    rounds = max(-(-points // ROUND_POINTS), 1)
    out = None
    for i in range(rounds):
        step = Workspace(polygons.sparkSession)
        one = ws.save(_multi_polygons(valid_rings(own.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == i), key, "rings", step), key))
        step.clear()
        out = one if out is None else out.unionByName(one)
    ws.drop(own)
    return out.select(key, F.flatten("parts").alias("rings"), "parts", "area")


_ENDS = ("sid", "x1", "y1", "x2", "y2")


def _delta(p: str = "") -> tuple[Column, Column]:
    return F.col(f"{p}x2") - F.col(f"{p}x1"), F.col(f"{p}y2") - F.col(f"{p}y1")


def _parallel() -> Column:
    (dx, dy), (ex, ey) = _delta(), _delta("b_")
    return F.abs(dx * ey - dy * ex) <= _NEAR * F.sqrt(dx * dx + dy * dy) * F.sqrt(ex * ex + ey * ey)


def _cuts() -> Column:
    """Where a segment meets another, b_, as parts of its length; 0 and 1 where that is itself."""
    c = F.col
    (dx, dy), (ex, ey) = _delta(), _delta("b_")
    gx, gy = c("b_x1") - c("x1"), c("b_y1") - c("y1")
    det, size = dx * ey - dy * ex, dx * dx + dy * dy
    t, u = (gx * ey - gy * ex) / F.nullif(det, F.lit(0.0)), (gx * dy - gy * dx) / F.nullif(det, F.lit(0.0))
    on_line = F.abs(gx * dy - gy * dx) <= 10**-DIGITS * 2 * F.sqrt(size)
    along = lambda p: ((c(f"b_x{p}") - c("x1")) * dx + (c(f"b_y{p}") - c("y1")) * dy) / size
    none = F.array().cast("array<double>")
    # a cut too many does no harm, one too few would, so ends may be missed by a trifle
    met = F.when(_parallel(), F.when(on_line, F.array(along(1), along(2))).otherwise(none)).when(u.between(-_NEAR, 1 + _NEAR), F.array(t)).otherwise(none)
    return F.when(c("sid") == c("b_sid"), F.array(F.lit(0.0), F.lit(1.0))).otherwise(met)


def _sides() -> list[Column]:
    """(beyond, on) of a piece and a segment b_: whether the ray from the piece's middle crosses it, and whether it lies there itself.

    Steep pieces send a ray to the right, flat ones one upwards.
    """
    c = F.col
    turned = lambda p, a, b: F.when(c("steep"), c(f"{p}{a}")).otherwise(c(f"{p}{b}"))
    p1, p2, q1, q2 = turned("b_", "x1", "y1"), turned("b_", "x2", "y2"), turned("b_", "y1", "x1"), turned("b_", "y2", "x2")
    spans = (q1 > c("at")) != (q2 > c("at"))
    cut = p1 + (c("at") - q1) * (p2 - p1) / F.nullif(q2 - q1, F.lit(0.0))
    own = (c("sid") == c("b_sid")) | (_parallel() & (F.abs(cut - c("m")) <= 10**-DIGITS * 2))
    return [(spans & ~own & (cut > c("m"))).cast("int").alias("beyond"), (spans & own).cast("int").alias("on")]


def covered_areas(polygons: DataFrame, key: str, rings: str = "rings", ws: Workspace | None = None) -> DataFrame:
    """(key, area): what ``make_valid`` gives as area, without its rings, for keys that have segments.

    Segments are cut where they meet. A piece is border if an odd number of segments lies there, and what lies beyond it
    on a ray tells on which side the inside is; borders with the inside on their left sum up to the area (Green). Cuts are
    parts of a segment's length and never rounded, so areas are as exact as coordinates. Polygons of ``ROW_SEGMENTS`` at
    most are compared within a row and dealt by their key once; segments of larger ones meet by cells of their size class.
    """
    ws = ws or Workspace(polygons.sparkSession)
    c = F.col
    own = ws.save(segments(polygons, key, rings).withColumn("sid", F.monotonically_increasing_id()))
    sizes = ws.save(own.groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    large = sizes.where(c("_n") > ROW_SEGMENTS).select(key)
    total, some = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0)) > ROW_SEGMENTS).first()
    tasks = max(-(-total // TASK_SEGMENTS), 8)
    small = own.join(large, key, "left_anti") if some else own
    second = F.transform("_in", lambda s: F.struct(*[s[n].alias(f"b_{n}") for n in _ENDS]))
    packed = small.repartition(tasks, key).groupBy(key).agg(F.collect_list(F.struct(*_ENDS)).alias("_in"))
    near = (F.least("x1", "x2") <= F.greatest("b_x1", "b_x2") + _NEAR) & (F.least("b_x1", "b_x2") <= F.greatest("x1", "x2") + _NEAR) & (F.least("y1", "y2") <= F.greatest("b_y1", "b_y2") + _NEAR) & (F.least("b_y1", "b_y2") <= F.greatest("y1", "y2") + _NEAR)
    met = packed.select(key, "_in", F.inline("_in")).select(key, *_ENDS, F.inline(second)).where(near)
    pieces = _pieces(met, key)
    other = packed.select(c(key).alias("_k"), second.alias("_in"))
    seen = pieces.join(other.hint("shuffle_hash"), c(key) == c("_k")).select(*pieces.columns, F.inline("_in"))
    out = _signed(seen, key)
    if some:
        out = out.unionByName(_areas_by_cells(own.join(large, key, "left_semi"), key, ws))
    return out.groupBy(key).agg(F.sum("area").alias("area"))


def _pieces(met: DataFrame, key: str) -> DataFrame:
    """Pieces of segments between the cuts of the pairs of segments: (key, sid, ends, t, t2, steep, at, m)."""
    c = F.col
    dx, dy = _delta()
    cut = met.select(key, *_ENDS, F.explode(_cuts()).alias("t")).where("t between 0 and 1")
    cut = cut.groupBy(key, *_ENDS).agg(F.array_sort(F.collect_set("t")).alias("_t"))
    spans = F.zip_with(F.slice("_t", 1, F.size("_t") - 1), F.slice("_t", 2, F.size("_t") - 1), lambda a, b: F.struct(a.alias("t"), b.alias("t2")))
    rows = cut.where(F.size("_t") > 1).select(key, *_ENDS, F.inline(spans)).withColumn("steep", F.abs(dx) < F.abs(dy))
    middle = (c("t") + c("t2")) / 2
    mx, my = c("x1") + middle * dx, c("y1") + middle * dy
    return rows.withColumns({"at": F.when(c("steep"), my).otherwise(mx), "m": F.when(c("steep"), mx).otherwise(my)})


def _signed(seen: DataFrame, key: str) -> DataFrame:
    """(key, area): a part of the area for each piece, of pieces and the segments that their rays may meet, themselves among them."""
    c = F.col
    dx, dy = _delta()
    piece = [key, *_ENDS, "t", "t2", "steep"]
    sides = seen.select(*piece, *_sides()).where("beyond + on > 0").groupBy(*piece).agg(F.sum("beyond").alias("n"), F.sum("on").alias("k"))
    # steep pieces that rise have the ray on their right, flat ones that run to the right on their left
    ray_left = F.when(c("steep"), dy < 0).otherwise(dx > 0)
    sign = F.when(ray_left == (c("n") % 2 == 1), 1.0).otherwise(-1.0)
    part = sign / c("k") * (c("t2") - c("t")) * (c("x1") * dy - c("y1") * dx) / 2
    return sides.where("k % 2 = 1").groupBy(key).agg(F.sum(part).alias("area"))


def _areas_by_cells(own: DataFrame, key: str, ws: Workspace) -> DataFrame:
    """(key, area) in parts, of segments that meet by cells."""
    c = F.col
    boxed = ws.save(_with_box(own))
    pair = box_pairs(boxed, boxed, key).where("_class < b__class or sid < b_sid")
    first, other = F.struct(*_ENDS, *[c(f"b_{n}") for n in _ENDS]), F.struct(*[c(f"b_{n}").alias(n) for n in _ENDS], *[c(n).alias(f"b_{n}") for n in _ENDS])
    both = pair.select(key, F.inline(F.array(first, other)))
    pieces = ws.save(_pieces(both.unionByName(own.select(key, *_ENDS, *[c(n).alias(f"b_{n}") for n in _ENDS])), key))
    level = {"left": F.lit(0.0), "right": F.lit(0.0)}
    seen = None
    for steep, q in ((True, "y"), (False, "x")):
        rays = pieces.where(c("steep") == steep).withColumns({**level, "bottom": c("at"), "top": c("at")})
        walls = own.where(f"{q}1 <> {q}2").withColumns({**level, "bottom": F.least(f"{q}1", f"{q}2"), "top": F.greatest(f"{q}1", f"{q}2")})
        found = box_pairs(rays, walls.select(key, *_ENDS, *level, "bottom", "top"), key).select(*pieces.columns, *[f"b_{n}" for n in _ENDS])
        seen = found if seen is None else seen.unionByName(found)
    return _signed(seen, key)


def _multi_polygons(found: DataFrame, key: str) -> DataFrame:
    """(key, parts, area) of valid rings."""
    one = found.groupBy(key, "shell").agg(F.sort_array(F.collect_list(F.struct((-F.col("area")).alias("a"), "ring", "points"))).alias("r"), F.sum("area").alias("area"))
    part = F.struct("shell", F.transform("r", lambda s: s["points"]).alias("rings"))
    return one.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["rings"]).alias("parts"), F.sum("area").alias("area"))
