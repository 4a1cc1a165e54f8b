"""Reference systems of columns, carried in their metadata.

    df = tagged(df, "lon", "lat", 4326)
    to = transformed(df, "lon", "lat", 2263)      # x and y in feet, tagged so
    aligned(df, to, ("lon", "lat"))                # raises: the systems differ

The tag travels with the column through selections, filters and joins, and through Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridweave.functions import geo

KEY = "crs"
#: Systems by EPSG number, from degrees (lon, lat) and back.
FROM_DEGREES = {4326: lambda x, y: (geo.col(x), geo.col(y)), 32618: lambda x, y: geo.utm(y, x), 2263: lambda x, y: geo.state_plane_feet(y, x)}
TO_DEGREES = {4326: lambda x, y: (geo.col(x), geo.col(y)), 32618: lambda x, y: geo.utm_inverse(x, y)[::-1], 2263: lambda x, y: geo.state_plane_degrees(x, y)[::-1]}


def tagged(df: DataFrame, x: str, y: str, epsg: int, override: bool = False) -> DataFrame:
    """``df`` with the columns said to be of a system; a tag that says otherwise is an error unless overridden."""
    for c in (x, y):
        had = crs_of(df, c)
        if had is not None and had != epsg and not override:
            raise ValueError(f"{c} is of EPSG:{had}, not EPSG:{epsg}")
        df = df.withMetadata(c, {**df.schema[c].metadata, KEY: epsg})
    return df


def crs_of(df: DataFrame, c: str) -> int | None:
    """The EPSG number of a column; None where it has none."""
    return df.schema[c].metadata.get(KEY)


def transformed(df: DataFrame, x: str, y: str, target: int) -> DataFrame:
    """``df`` with its tagged columns in another system."""
    a, b = crs_of(df, x), crs_of(df, y)
    if a is None or a != b:
        raise ValueError(f"{x} and {y} are of {a} and {b}")
    if target not in FROM_DEGREES or a not in TO_DEGREES:
        raise ValueError(f"EPSG:{a if target in FROM_DEGREES else target} isn't known")
    if a != target:  # degrees are columns in between, so that they are worked out once
        lon, lat = TO_DEGREES[a](x, y)
        df = df.withColumns({"_lon": lon, "_lat": lat})
        nx, ny = FROM_DEGREES[target]("_lon", "_lat")
        df = df.withColumns({x: nx, y: ny}).drop("_lon", "_lat")
    return tagged(df, x, y, target, override=True)


def aligned(left: DataFrame, right: DataFrame, xy=("x", "y"), to: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both frames in one system: ``to``, if given, else they must agree already; untagged columns go with the others."""
    systems = [{crs_of(df, c) for c in xy} for df in (left, right)]
    if any(len(s) > 1 for s in systems):
        raise ValueError(f"columns {xy} of one frame are of {systems}")
    a, b = (s.pop() for s in systems)
    if to is None:
        if a is not None and b is not None and a != b:
            raise ValueError(f"EPSG:{a} doesn't meet EPSG:{b}")
        return left, right
    if a is None or b is None:
        raise ValueError("a frame without a system can't be transformed")
    return transformed(left, *xy, to), transformed(right, *xy, to)
