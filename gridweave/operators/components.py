"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.workspace import Workspace


def _roots(parent: DataFrame, ws: Workspace) -> DataFrame:
    """(id, parent) -> (id, root) by pointer jumping: the steps are the logarithm of the depth."""
    while True:
        up = parent.select(F.col("id").alias("_id"), F.col("parent").alias("_up"))
        jumped = parent.join(up, parent["parent"] == up["_id"], "left").select("id", F.coalesce("_up", "parent").alias("next"), "parent")
        jumped = ws.save(jumped)
        moved = not jumped.where("next <> parent").isEmpty()
        ws.drop(parent)
        parent = jumped.select("id", F.col("next").alias("parent"))
        if not moved:
            return parent.withColumnRenamed("parent", "root")


def components(edges: DataFrame, ws: Workspace, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of every vertex that has an edge; the component is its smallest id.

    Each round a vertex joins its smallest neighbour if that is smaller, roots are found by
    pointer jumping, and edges are drawn between roots, so at least half of the vertices go in
    each round and a hub's edges fall together. Nulls and loops are left out.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = ws.save(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    found = None
    while not e.isEmpty():
        both = e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("near")), F.struct(F.col("v").alias("id"), F.col("u").alias("near")))).alias("x")).select("x.*")
        parent = ws.save(both.groupBy("id").agg(F.least(F.min("near"), F.col("id")).alias("parent")))
        roots = _roots(parent, ws)
        if found is None:
            found = roots.withColumnRenamed("root", "component")
        else:
            later = roots.withColumnRenamed("id", "_r")
            found = ws.save(found.join(later, found["component"] == later["_r"], "left").select("id", F.coalesce("root", "component").alias("component")))
        a = roots.select(F.col("id").alias("u"), F.col("root").alias("_ru"))
        b = roots.select(F.col("id").alias("v"), F.col("root").alias("_rv"))
        nxt = e.join(a, "u").join(b, "v").where("_ru <> _rv").select(F.greatest("_ru", "_rv").alias("u"), F.least("_ru", "_rv").alias("v")).distinct()
        e = ws.save(nxt)
    if found is None:
        found = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found
