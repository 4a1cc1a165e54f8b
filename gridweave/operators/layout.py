"""Spring layout of a graph of any size: coarser graphs first, repulsion summed by cells.

A node's forces are those of Fruchterman and Reingold with an ideal length of 1. Repulsion between all pairs is
told by a pyramid of grid cells: nodes feel the nine cells around them singly, and farther ones
through the forces between cells, each pair of cells on the coarsest level that sets them apart.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.workspace import Workspace

#: Nodes of a cell on the finest level, about; nodes of the coarsest graph; graphs at most.
CELL_NODES, COARSEST, GRAPHS = 6, 50, 12
SEED = 17


def _coarser(edges: DataFrame, nodes: DataFrame, level: int, ws: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((n, up), nodes and edges of the graph above): nodes with the same first-ranked neighbour, or self, become one."""
    rank = lambda n: F.struct(F.xxhash64(n, F.lit(SEED + level)).alias("h"), F.col(n).alias("n"))
    around = edges.select(F.col("u").alias("n"), rank("v").alias("r")).unionByName(nodes.select("n", rank("n").alias("r")))
    up = ws.save(around.groupBy("n").agg(F.min("r").alias("r")).select("n", F.col("r.n").alias("up")))
    a, b = up.select(F.col("n").alias("u"), F.col("up").alias("_u")), up.select(F.col("n").alias("v"), F.col("up").alias("_v"))
    above = ws.save(edges.join(a, "u").join(b, "v").where("_u <> _v").select(F.col("_u").alias("u"), F.col("_v").alias("v")).distinct())
    return up, ws.save(up.select(F.col("up").alias("n")).distinct()), above


def _cells(at: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(nodes with their finest cell, that level): cells of a square grid around all nodes."""
    x0, y0, x1, y1 = at.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    side, depth = max(x1 - x0, y1 - y0, 1e-9) * 1.000001, max(0, math.ceil(math.log(max(n / CELL_NODES, 1), 4)))
    place = lambda v, o: F.floor((F.col(v) - F.lit(o)) / F.lit(side) * F.lit(1 << depth)).cast("long")
    return at.withColumns({"cx": place("x", x0), "cy": place("y", y0)}), depth


def repulsion(at: DataFrame, n: int) -> DataFrame:
    """(n, x, y, fx, fy): the sum over all other nodes of the difference of places over its square, about.

    Forces of far cells are summed down the pyramid to the finest cells, which hold their neighbours' sums in an
    array, so a node is a row throughout.
    """
    rows, depth = _cells(at, n)
    c = F.col
    finest = rows.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("m"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    over = finest.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("up"), "cx", "cy", "m", "sx", "sy").select((F.lit(depth) - c("up")).alias("level"), F.expr("shiftright(cx, up)").alias("cx"), F.expr("shiftright(cy, up)").alias("cy"), "m", "sx", "sy")
    cells = over.groupBy("level", "cx", "cy").agg(F.sum("m").alias("m"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy")).where("level >= 2")
    around = lambda r: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-r, r + 1) for j in range(-r, r + 1)])).alias("k")
    apart = "(abs(k.i) > 1 or abs(k.j) > 1) and abs(shiftright(cx + k.i, 1) - shiftright(cx, 1)) <= 1 and abs(shiftright(cy + k.j, 1) - shiftright(cy, 1)) <= 1"
    there = [(c("cx") + c("k.i")).alias("cx"), (c("cy") + c("k.j")).alias("cy")]
    acts = cells.select("level", "cx", "cy", "m", (c("sx") / c("m")).alias("qx"), (c("sy") / c("m")).alias("qy"), around(3)).where(apart).select("level", *there, c("m").alias("q"), "qx", "qy")
    dx, dy = c("sx") / c("m") - c("qx"), c("sy") / c("m") - c("qy")
    d2 = F.greatest(dx * dx + dy * dy, F.lit(1e-6))
    far = acts.join(cells, ["level", "cx", "cy"]).groupBy("level", "cx", "cy").agg(F.sum(dx / d2 * c("q")).alias("gx"), F.sum(dy / d2 * c("q")).alias("gy"))
    down = finest.select(c("cx").alias("_cx"), c("cy").alias("_cy"), F.explode(F.sequence(F.lit(0), F.lit(max(depth - 2, 0)))).alias("up"))
    down = down.select("_cx", "_cy", (F.lit(depth) - c("up")).alias("level"), F.expr("shiftright(_cx, up)").alias("cx"), F.expr("shiftright(_cy, up)").alias("cy"))
    far = down.join(far, ["level", "cx", "cy"]).groupBy(c("_cx").alias("cx"), c("_cy").alias("cy")).agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"))
    beside = finest.select("cx", "cy", "m", "sx", "sy", around(1)).select(*there, F.struct(((c("k.i") == 0) & (c("k.j") == 0)).cast("int").alias("own"), "m", "sx", "sy").alias("b"))
    beside = beside.groupBy("cx", "cy").agg(F.collect_list("b").alias("beside"))

    def felt(axis):
        def add(total, b):
            m = b["m"] - b["own"]
            dx, dy = (c(v) - (b[s] - b["own"] * c(v)) / m for v, s in (("x", "sx"), ("y", "sy")))
            d2 = F.greatest(dx * dx + dy * dy, F.lit(1e-2))
            return F.when(m > 0, total + (dx if axis == "x" else dy) / d2 * m).otherwise(total)

        return F.aggregate("beside", F.lit(0.0), add)

    out = rows.join(beside.join(far, ["cx", "cy"], "left"), ["cx", "cy"])
    return out.select("n", "x", "y", *[(F.coalesce(f"g{v}", F.lit(0.0)) + felt(v)).alias(f"f{v}") for v in ("x", "y")])


def _moved(at: DataFrame, edges: DataFrame, n: int, heat: float, ws: Workspace) -> DataFrame:
    """Places after one round: repulsion, and attraction along edges by the square of their length."""
    c = F.col
    a = at.select(c("n").alias("u"), c("x").alias("ux"), c("y").alias("uy"))
    b = at.select(c("n").alias("v"), c("x").alias("vx"), c("y").alias("vy"))
    dx, dy = c("vx") - c("ux"), c("vy") - c("uy")
    long = F.sqrt(dx * dx + dy * dy)
    # by v first: what lies by u then is summed where it lies
    pull = edges.join(b, "v").join(a, "u").groupBy(c("u").alias("n")).agg(F.sum(dx * long).alias("ax"), F.sum(dy * long).alias("ay"))
    out = repulsion(at, n).join(pull, "n", "left")
    fx, fy = (c(f) + F.coalesce(g, F.lit(0.0)) for f, g in (("fx", "ax"), ("fy", "ay")))
    out = out.select("n", "x", "y", fx.alias("fx"), fy.alias("fy")).withColumn("size", F.greatest(F.sqrt(c("fx") * c("fx") + c("fy") * c("fy")), F.lit(1e-9)))
    step = F.least("size", F.lit(heat)) / c("size")
    return ws.save(out.select("n", (c("x") + c("fx") * step).alias("x"), (c("y") + c("fy") * step).alias("y")))


def spring_layout(nodes: DataFrame, edges: DataFrame, rounds: int = 12, node_id: str = "node_id", ws: Workspace | None = None) -> DataFrame:
    """(node_id, x, y) of a Fruchterman-Reingold layout; neighbours lie about a length of 1 apart.

    Directions of edges and loops don't count, edges to absent nodes and null ids are left out, repeated nodes are one.
    Places begin as hashes of the ids of a coarsest graph and are handed down from graph to finer graph,
    each of which is moved ``rounds`` times, so reruns agree but for the order of sums. Nodes
    are never collected: a round is joins by cells and by the ends of edges.
    """
    ws = ws or Workspace(nodes.sparkSession)
    c = F.col
    own = ws.save(nodes.select(c(node_id).alias("n")).where("n is not null").distinct())
    e = edges.select("u", "v").where("u <> v").join(own.withColumnRenamed("n", "u"), "u", "left_semi").join(own.withColumnRenamed("n", "v"), "v", "left_semi")
    e = ws.save(e.select(F.explode(F.array(F.struct("u", "v"), F.struct(c("v").alias("u"), c("u").alias("v")))).alias("e")).select("e.*").distinct())
    graphs, ups, count = [(own, e, own.count())], [], own.count()
    while count > COARSEST and len(graphs) < GRAPHS:
        up, above, joined = _coarser(graphs[-1][1], graphs[-1][0], len(graphs), ws)
        fewer = above.count()
        if fewer > 0.9 * count:
            break
        ups.append(up)
        graphs.append((above, joined, fewer))
        count = fewer
    part = lambda n, salt: F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    last, n_last = graphs[-1][0], graphs[-1][2]
    at = ws.save(last.select("n", *[(part("n", s) * F.lit(max(n_last, 1) ** 0.5)).alias(v) for v, s in (("x", 1), ("y", 2))]))
    for level in range(len(graphs) - 1, -1, -1):
        _, joined, n = graphs[level]
        if level < len(graphs) - 1:  # what was one lies close together, on the finer graph's scale
            scale = (n / graphs[level + 1][2]) ** 0.5
            before, up = at, ups[level].select("n", c("up").alias("_up"))
            spot = lambda v, s: (c(v) * F.lit(scale) + part("n", s) - 0.5).alias(v)
            at = ws.save(up.join(before.withColumnRenamed("n", "_up"), "_up").select("n", spot("x", 3), spot("y", 4)))
            ws.drop(before)
        heat = max(1.0, 0.15 * n**0.5) if level == len(graphs) - 1 else 1.5
        for _ in range(rounds if n > 1 else 0):
            before, at = at, _moved(at, joined, n, heat, ws)
            ws.drop(before)
            heat *= 0.85
    return at.select(c("n").alias(node_id), "x", "y")
