"""Render-ready tables: styles, exposure of edges, popups and drawing order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.geo import midpoint
from gridweave.functions.text import depth_colour, depth_radius, label, popup, segment
from gridweave.operators.graph import degrees, is_recovery
from gridweave.operators.joins import with_ends

# Colours and sizes by kind of node; anything else is grey.
STYLES = [("power", "#E6A817", 12), ("telecom", "#7B4FA3", 5), ("hospital", "#D62728", 10), ("subway", "#1F77B4", 6), ("water", "#17BECF", 9), ("fuel", "#8C564B", 8)]
DEFAULT_STYLE = ("#888888", 6)


def exposed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their ends' depths, the larger one, and how many ends are flooded."""
    e = with_ends(edges, nodes, ["depth_m"])
    u, v = F.coalesce("u_depth_m", F.lit(0.0)), F.coalesce("v_depth_m", F.lit(0.0))
    return e.withColumns({"u_depth_m": u, "v_depth_m": v, "max_depth_m": F.greatest(u, v), "flooded_ends": (u > 0).cast("int") + (v > 0).cast("int")})


def node_layer(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with colour, size by out-degree, fill, popup and tooltip."""
    style = nodes.sparkSession.createDataFrame(STYLES, "infra_type string, colour string, size int")
    out = nodes.join(F.broadcast(style), "infra_type", "left").join(degrees(edges, nodes), "node_id")
    external = F.coalesce("external", F.lit(False))
    caption = [F.concat(F.lit("<b>"), F.col("name"), F.lit("</b>")), segment("Type:", label("infra_type"))]
    for c, text in (("subtype", "Subtype:"), ("operator", "Operator:"), ("tower_count", "Towers:"), ("routes", "Routes:"), ("address", "Address:"), ("brand", "Brand:"), ("depth_m", "Depth (m):")):
        if c in nodes.columns:
            caption.append(segment(text, c))
    caption.append(F.concat(F.lit("<b>Edges:</b> "), F.col("out_degree").cast("string"), F.lit(" out, "), F.col("in_degree").cast("string"), F.lit(" in")))
    return out.withColumns({
        "colour": F.coalesce("colour", F.lit(DEFAULT_STYLE[0])),
        "radius": F.coalesce("size", F.lit(DEFAULT_STYLE[1])) * 1.2 + F.col("out_degree") * 1.5,
        "fill": F.when(external, "none").otherwise(F.coalesce("colour", F.lit(DEFAULT_STYLE[0]))),
        "popup": popup(caption), "tooltip": F.concat_ws(" - ", "name", label("infra_type")),
    })


def edge_layer(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ends, middle, layer, drawing order (recovery below cascade) and popup."""
    e = with_ends(edges, nodes, ["lat", "lon"], how="inner")
    return e.withColumns({
        "mid_lat": midpoint("u_lat", "v_lat"), "mid_lon": midpoint("u_lon", "v_lon"),
        "layer": F.when(is_recovery(), "recovery").otherwise("cascade"), "z": F.when(is_recovery(), 0).otherwise(1),
        "popup": popup([F.concat(F.lit("<b>"), label("edge_type"), F.lit("</b>")), F.concat("u", F.lit(" to "), "v"), segment("Distance (m):", "distance_m"), segment("Buffer (h):", "buffer_hours")]),
    })


def depth_circles(nodes: DataFrame) -> DataFrame:
    return nodes.where("depth_m > 0").withColumns({"fill": depth_colour("depth_m"), "radius": depth_radius("depth_m")})
