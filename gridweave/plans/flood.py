"""Hazard overlay by division, and its validation against observed extents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.geo import state_plane_feet
from gridweave.operators.joins import first_box, inside_any_polygon


def overlay(nodes: DataFrame, divisions: DataFrame, depths: DataFrame, project: bool = True, node_id: str = "node_id") -> DataFrame:
    """Nodes with division (-1: none), depth_m, warm_m and inundated.

    ``divisions``: left, bottom, right, top in the plane of the projection, or of x and y where
    ``project`` is false; ``depths``: division, cold, warm. Depths are to three decimals.
    """
    placed = nodes.withColumns(dict(zip(("_x", "_y"), state_plane_feet("lat", "lon"), strict=True))) if project else nodes.withColumns({"_x": F.col("x"), "_y": F.col("y")})
    found = first_box(placed, divisions, node_id, "division", ("_x", "_y"))
    told = found.join(F.broadcast(depths) if depths.count() <= 10_000 else depths, "division", "left")
    depth = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 3)
    told = told.select(node_id, "division", depth("cold").alias("depth_m"), depth("warm").alias("warm_m"))
    return nodes.join(told, node_id).withColumn("inundated", F.col("depth_m") > 0)


def observed(nodes: DataFrame, polygons: DataFrame, node_id: str = "node_id") -> DataFrame:
    """Nodes with ``observed``: strictly inside an observed polygon."""
    return inside_any_polygon(nodes, polygons, node_id, "rings", ("lon", "lat"), "observed")


def flooded_listing(nodes: DataFrame) -> DataFrame:
    """Critical nodes that are under water."""
    return nodes.where(F.col("infra_type").isin("power", "hospital", "water") & F.col("inundated")).select("name", "infra_type", "division", "depth_m")


def division_status(division="division", depth="depth_m"):
    return F.when(F.col(division) < 0, "external").when(F.col(depth) > 0, "FLOODED").otherwise("dry")


def summary_lines(overall) -> list[str]:
    """Text of a row of ``flood_overall``."""
    return [f"nodes {overall.total:,}", f"mapped {overall.mapped:,}", f"external {overall.external:,}", f"flooded {overall.flooded:,} ({overall.pct_flooded:.1f} %)", f"dry {overall.dry:,}"]
