"""Measures of a directed graph held as an edge table (u, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.operators.components import components
from gridweave.operators.ordering import if_few, ordinal
from gridweave.workspace import Workspace


def degrees(edges: DataFrame, nodes: DataFrame, node_id: str = "node_id") -> DataFrame:
    """(node_id, out_degree, in_degree) over distinct (u, v); nodes without edges have 0."""
    e = edges.select("u", "v").distinct()
    ends = F.explode(F.array(F.struct(F.col("u").alias("_n"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("v").alias("_n"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    d = e.select(ends.alias("x")).select("x.*").groupBy("_n").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    out = nodes.select(node_id).join(d, F.col(node_id) == F.col("_n"), "left")
    return out.select(node_id, F.coalesce("o", F.lit(0)).cast("long").alias("out_degree"), F.coalesce("i", F.lit(0)).cast("long").alias("in_degree"))


def degree_centrality(edges: DataFrame, nodes: DataFrame, node_id: str = "node_id") -> DataFrame:
    """Degree over the number of other nodes; a lone node has 0."""
    n = nodes.count()
    d = degrees(edges, nodes, node_id)
    return d.select(node_id, ((F.col("out_degree") + F.col("in_degree")) / F.lit(float(max(n - 1, 1)))).alias("degree_centrality"))


def top_degrees(edges: DataFrame, nodes: DataFrame, k: int = 5, side: str = "out_degree", order: str | None = None, node_id: str = "node_id") -> DataFrame:
    """The ``k`` nodes of largest degree, ties by ``order``."""
    order = order or node_id
    d = degrees(edges, nodes, node_id)
    if order != node_id:
        d = d.join(nodes.select(node_id, order), node_id)
    return d.orderBy(F.desc(side), order).limit(k).select(node_id, side)


def mean_degree_by(edges: DataFrame, nodes: DataFrame, kind: str = "infra_type", node_id: str = "node_id") -> DataFrame:
    d = degrees(edges, nodes, node_id).join(nodes.select(node_id, kind), node_id)
    return d.groupBy(kind).agg(F.avg("out_degree").alias("mean_out_degree"))


def largest_at_ends(edges: DataFrame, value: Column, name: str) -> DataFrame:
    """(node_id, name): the largest value of a node's edges in either direction."""
    ends = edges.where(value.isNotNull()).select(F.explode(F.array("u", "v")).alias("node_id"), value.alias("_x"))
    return ends.groupBy("node_id").agg(F.max("_x").alias(name))


def weak_components(edges: DataFrame, nodes: DataFrame, node_id: str = "node_id", ws: Workspace | None = None) -> DataFrame:
    """(node_id, component): the smallest node reachable when direction doesn't count."""
    ws = ws or Workspace(edges.sparkSession)
    found = components(edges, ws, "u", "v")
    out = nodes.select(node_id).join(found, F.col(node_id) == F.col("id"), "left")
    return out.select(node_id, F.coalesce("component", node_id).alias("component"))


def _step(labels: DataFrame, edges: DataFrame, ws: Workspace) -> DataFrame:
    """One round of spreading: labels (n, c, p) take the least of their own, their in-neighbours' and their shortcut's.

    ``p`` is a node that reaches ``n``. It jumps to its own shortcut's, so it is twice as far back each round; a node that
    an in-neighbour gives a lesser label takes that one's.
    """
    sent = edges.join(labels.select(F.col("n").alias("u"), F.struct(F.col("c").alias("c"), F.col("p").alias("p")).alias("_in")).hint("merge"), "u").groupBy("v").agg(F.min("_in").alias("_in"))
    back = labels.select(F.col("n").alias("_n"), F.col("c").alias("_c"), F.col("p").alias("_p"))
    out = labels.join(sent.hint("merge"), labels["n"] == sent["v"], "left").join(back.hint("merge"), labels["p"] == back["_n"], "left")
    near, far = F.coalesce(F.col("_in.c"), F.col("c")), F.coalesce(F.col("_c"), F.col("c"))
    least = F.least("c", near, far)
    out = out.select("n", least.alias("c"), F.when((near < F.col("c")) & (near < far), F.col("_in.p")).otherwise(F.coalesce("_p", "p")).alias("p"), (least < F.col("c")).alias("moved"))
    return ws.save(out)


def _spread(labels: DataFrame, edges: DataFrame, ws: Workspace) -> DataFrame:
    """Least label that reaches each node along edges, to a fixed point; labels are (n, c).

    Shortcuts double their reach each round, so a long chain takes about the logarithm of its edges.
    """
    first = edges.groupBy("v").agg(F.min("u").alias("_u"))
    labels = labels.join(first.hint("merge"), labels["n"] == first["v"], "left").select("n", "c", F.coalesce("_u", "n").alias("p"))
    before = None
    while True:
        nxt = _step(labels, edges, ws)
        ws.drop(before)
        before, labels = nxt, nxt.select("n", "c", "p")
        if nxt.where("moved").isEmpty():
            return nxt.select("n", "c")


def strong_components(edges: DataFrame, nodes: DataFrame, node_id: str = "node_id", ws: Workspace | None = None) -> DataFrame:
    """(node_id, component): the smallest node of the strongly connected component.

    Nodes are ranked by a hash. Each takes the first-ranked node that reaches it as its pivot; what reaches a
    pivot within its area is its component. Edges between areas can't be in one and go, and so do nodes
    without edges in or out; the rest goes round again. Since pivots are random, areas fall to parts of
    themselves, and rounds are about the square of the logarithm of the nodes. Joins are merges: a round's tables that
    are just small enough to be broadcast would pass through the driver, which over all rounds is much.
    """
    ws = ws or Workspace(edges.sparkSession)
    e = ws.save(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    rank = lambda n: F.struct(F.xxhash64(n, F.lit(len(done))).alias("h"), F.col(n).alias("n"))
    done: list[DataFrame] = []
    while not e.isEmpty():
        heads, tails = e.select(F.col("v").alias("n")).distinct(), e.select(F.col("u").alias("n")).distinct()
        inner = ws.save(heads.join(tails.hint("merge"), "n", "left_semi"))
        e = ws.save(e.join(inner.withColumnRenamed("n", "u").hint("merge"), "u", "left_semi").join(inner.withColumnRenamed("n", "v").hint("merge"), "v", "left_semi").select("u", "v"))
        pivot = _spread(inner.select("n", rank("n").alias("c")), e, ws).select("n", F.col("c.n").alias("c"))
        cu, cv = pivot.select(F.col("n").alias("u"), F.col("c").alias("_cu")), pivot.select(F.col("n").alias("v"), F.col("c").alias("_cv"))
        within = ws.save(e.join(cu.hint("merge"), "u").join(cv.hint("merge"), "v").where("_cu = _cv").select("u", "v"))
        # against the edges, a pivot is the least label of all that reach it
        own = pivot.select("n", F.struct(F.when(F.col("n") == F.col("c"), 0).otherwise(1).alias("k"), F.when(F.col("n") == F.col("c"), F.col("c")).otherwise(F.col("n")).alias("c")).alias("c"))
        back = _spread(own, within.select(F.col("v").alias("u"), F.col("u").alias("v")), ws)
        part = ws.save(back.where("c.k = 0").select(F.col("n").alias("id"), F.col("c.c").alias("_root")))
        least = part.groupBy("_root").agg(F.min("id").alias("component"))
        done.append(ws.save(part.join(least.hint("merge"), "_root").select("id", "component")))
        gone = part.select("id")
        before, e = e, ws.save(within.join(gone.withColumnRenamed("id", "u").hint("merge"), "u", "left_anti").join(gone.withColumnRenamed("id", "v").hint("merge"), "v", "left_anti").select("u", "v"))
        ws.drop(before, within, inner, part)
    out = nodes.select(node_id)
    if not done:
        return out.select(node_id, F.col(node_id).alias("component"))
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return out.join(found.hint("merge"), out[node_id] == found["id"], "left").select(node_id, F.coalesce("component", node_id).alias("component"))


def is_recovery(layer: str = "layer") -> Column:
    """Edges of the recovery layer; all others are the cascade layer."""
    return F.coalesce(F.col(layer), F.lit("")) == "recovery"


def consecutive_pairs(stations: DataFrame, line: str = "line", node_id: str = "node_id", order: str = "ord") -> DataFrame:
    """(line, u, v, ...): neighbours along each line, sorted by its longer axis.

    Stations carry lat and lon; the axis is longitude where its extent is strictly larger.
    """
    on = Window.partitionBy(line)
    wide = (F.max("lon").over(on) - F.min("lon").over(on)) > (F.max("lat").over(on) - F.min("lat").over(on))
    rows = stations.withColumn("_key", F.when(wide, F.col("lon")).otherwise(F.col("lat")))
    along = Window.partitionBy(line).orderBy("_key", order)
    rows = rows.select(line, F.col(node_id).alias("u"), F.lead(node_id).over(along).alias("v"), F.row_number().over(along).alias("step"))
    return rows.where("v is not null")


def local_index(nodes: DataFrame, kind: str = "infra_type", order: str = "ord", ws: Workspace | None = None) -> DataFrame:
    """Add ``idx``: 0, 1, 2, ... within each kind.

    All nodes are numbered by kind and order, and each kind's first number is taken off, so a kind isn't one task's.
    """
    ws = ws or Workspace(nodes.sparkSession)
    rows = ws.save(ordinal(nodes, [F.col(kind), F.col(order)], ws, "_o"))
    first = rows.groupBy(F.col(kind).alias("_kind")).agg(F.min("_o").alias("_first"))
    out = rows.join(if_few(first), rows[kind].eqNullSafe(first["_kind"]))
    return out.withColumn("idx", F.col("_o") - F.col("_first")).drop("_o", "_kind", "_first")


def stations_by_line(nodes: DataFrame, routes: str = "routes", node_id: str = "node_id", order: str = "ord") -> DataFrame:
    """(line, stations): ids of each line's stations in node order."""
    from gridweave.functions.text import tokens

    rows = nodes.select(F.explode(tokens(routes)).alias("line"), order, node_id)
    listed = F.array_sort(F.collect_list(F.struct(order, node_id)))
    return rows.groupBy("line").agg(F.transform(listed, lambda x: x[node_id]).alias("stations"))
