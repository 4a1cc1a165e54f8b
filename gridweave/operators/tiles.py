"""Features by map tile and zoom, for drawing: a pyramid of Web Mercator tiles.

Each feature is cut to the tiles that it touches and comes in a tile's own whole units, so what is drawn of a tile
is read from one place, and little of it at far zooms: lines are simplified to what a unit shows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.geo import col

#: Units of a tile's side.
UNITS = 4096


def mercator(lat, lon) -> tuple[Column, Column]:
    """(u, v) in 0..1 from the north-west corner of the map; latitudes beyond the map are its edge."""
    y = F.radians(F.when(col(lat).isNotNull(), F.greatest(F.least(col(lat), F.lit(85.05112878)), F.lit(-85.05112878))))  # least and greatest pass over a null
    v = F.lit(0.5) - F.log(F.tan(F.lit(math.pi / 4) + y / 2)) / F.lit(2 * math.pi)
    return (col(lon) + 180.0) / 360.0, F.when(v < 0, 0.0).when(v > 1, 1.0).otherwise(v)


def _zoomed(df: DataFrame, zooms: Sequence[int]) -> DataFrame:
    return df.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms])))


def point_tiles(points: DataFrame, key: str, zooms: Sequence[int], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(zoom, tx, ty, key, x, y): each point's tile on each zoom, and its place there in units; unplaced points go."""
    u, v = mercator(lat, lon)
    rows = _zoomed(points.select(F.col(key).alias("key"), u.alias("u"), v.alias("v")).where("u is not null and v is not null"), zooms)
    tiles = F.pow(F.lit(2.0), "zoom")
    at = lambda c: F.least(F.floor(F.col(c) * tiles), tiles - 1).cast("int")
    rows = rows.withColumns({"tx": at("u"), "ty": at("v")})
    unit = lambda c, t: F.floor((F.col(c) * tiles - F.col(t)) * UNITS).cast("int")
    return rows.select("zoom", "tx", "ty", "key", unit("u", "tx").alias("x"), unit("v", "ty").alias("y"))


def line_tiles(lines: DataFrame, key: str, zooms: Sequence[int], coordinates: str = "coordinates") -> DataFrame:
    """(zoom, tx, ty, key, part, x1, y1, x2, y2): pieces of lines, arrays of [lon, lat], cut to tiles.

    On each zoom corners are put on the grid of units and repeated ones dropped; what is shorter than a unit there goes.
    A piece is found by the columns of tiles that it crosses and, in each, by the rows between where it enters and
    leaves, so a long line makes as many pieces as it crosses tiles. Points with a null are left out.
    """
    c = F.col
    point = F.transform(F.filter(c(coordinates), lambda p: F.coalesce(F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull(), F.lit(False))), lambda p: F.struct(*[e.alias(n) for n, e in zip("uv", mercator(p[1], p[0]), strict=True)]))
    rows = _zoomed(lines.select(c(key).alias("key"), point.alias("_p")), zooms)
    side = F.pow(F.lit(2.0), "zoom") * UNITS
    rows = rows.withColumn("_p", F.transform("_p", lambda p: F.struct(F.round(p["u"] * side).cast("long").alias("u"), F.round(p["v"] * side).cast("long").alias("v"))))
    rows = rows.withColumn("_p", F.filter("_p", lambda p, i: (i == 0) | (p != F.get("_p", F.greatest(i - 1, F.lit(0))))))
    rows = rows.where(F.size("_p") > 1).select("key", "zoom", F.posexplode(F.zip_with(F.slice("_p", 1, F.size("_p") - 1), F.slice("_p", 2, F.size("_p") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("part", "s"))
    rows = rows.select("key", "zoom", "part", c("s.a.u").alias("u1"), c("s.a.v").alias("v1"), c("s.b.u").alias("u2"), c("s.b.v").alias("v2"))
    tile = lambda e: F.floor(e / F.lit(UNITS)).cast("int")
    rows = rows.withColumn("tx", F.explode(F.sequence(tile(F.least("u1", "u2")), tile(F.greatest("u1", "u2")))))
    left, right = c("tx") * UNITS, (c("tx") + 1) * UNITS
    low, high = F.greatest(F.least("u1", "u2"), left), F.least(F.greatest("u1", "u2"), right)
    at = lambda u: F.when(c("u1") == c("u2"), F.lit(None)).otherwise(c("v1") + (u - c("u1")) * (c("v2") - c("v1")) / (c("u2") - c("u1")))
    rows = rows.withColumns({"_a": F.coalesce(at(low), c("v1").cast("double")), "_b": F.coalesce(at(high), c("v2").cast("double"))})
    rows = rows.withColumn("ty", F.explode(F.sequence(tile(F.least("_a", "_b")), tile(F.greatest("_a", "_b")))))
    # the piece in a tile: the line between the sides of the column, cut by the row's
    top, bottom = c("ty") * UNITS, (c("ty") + 1) * UNITS
    du, dv = c("u2") - c("u1"), c("v2") - c("v1")
    ends = [F.try_divide(s - c(o), d) for s, o, d in ((left, "u1", du), (right, "u1", du), (top, "v1", dv), (bottom, "v1", dv))]
    first = F.greatest(F.lit(0.0), F.coalesce(F.least(ends[0], ends[1]), F.lit(0.0)), F.coalesce(F.least(ends[2], ends[3]), F.lit(0.0)))
    last = F.least(F.lit(1.0), F.coalesce(F.greatest(ends[0], ends[1]), F.lit(1.0)), F.coalesce(F.greatest(ends[2], ends[3]), F.lit(1.0)))
    rows = rows.withColumns({"_t": first, "_s": last})
    place = lambda t, o, d, base: F.round(c(o) + c(t) * d - base).cast("int")
    return rows.where("_t <= _s").select("zoom", "tx", "ty", "key", "part", place("_t", "u1", du, left).alias("x1"), place("_t", "v1", dv, top).alias("y1"), place("_s", "u1", du, left).alias("x2"), place("_s", "v1", dv, top).alias("y2"))
