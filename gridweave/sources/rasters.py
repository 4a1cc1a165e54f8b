"""Bounds of GeoTIFF rasters from their tag directories; no pixel is read."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.operators.ordering import ordinal
from gridweave.workspace import Workspace, ship

# TIFF tags of width, height, pixel scale, tie point and transformation, and the sizes of field types.
WIDTH, HEIGHT, SCALE, TIE_POINT, TRANSFORMATION = 256, 257, 33550, 33922, 34264
FORMATS = {1: "B", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}


def tags(content: bytes) -> dict[int, tuple]:
    """Numeric tags of the first directory of a TIFF or BigTIFF file."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or len(content) < 8:
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(order + "H", content, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), content, 8 if big else 4)[0]
    n = struct.unpack_from(order + ("Q" if big else "H"), content, at)[0]
    at, size, inline = at + (8 if big else 2), 20 if big else 12, 8 if big else 4
    out = {}
    for i in range(n):
        tag, kind = struct.unpack_from(order + "HH", content, at + i * size)
        count = struct.unpack_from(order + ("Q" if big else "I"), content, at + i * size + 4)[0]
        if kind in FORMATS:
            place = at + i * size + 4 + inline
            if struct.calcsize(FORMATS[kind]) * count > inline:
                place = struct.unpack_from(order + ("Q" if big else "I"), content, place)[0]
            out[tag] = struct.unpack_from(f"{order}{count}{FORMATS[kind]}", content, place)
    return out


def bounds(content: bytes) -> tuple[float, float, float, float]:
    """(left, bottom, right, top) of a raster, also one that is turned: the box around its corners."""
    t = tags(content)
    w, h = t[WIDTH][0], t[HEIGHT][0]
    if TRANSFORMATION in t:
        m = t[TRANSFORMATION]
        corners = [(m[0] * i + m[1] * j + m[3], m[4] * i + m[5] * j + m[7]) for i in (0, w) for j in (0, h)]
    elif SCALE in t and TIE_POINT in t:
        (sx, sy), (i0, j0, _, x0, y0) = t[SCALE][:2], t[TIE_POINT][:5]
        corners = [(x0 + (i - i0) * sx, y0 - (j - j0) * sy) for i in (0, w) for j in (0, h)]
    else:
        raise ValueError("a raster without a place")
    return min(x for x, _ in corners), min(y for _, y in corners), max(x for x, _ in corners), max(y for _, y in corners)


def tag_bounds(files: DataFrame) -> DataFrame:
    """(path, left, bottom, right, top) of rows (path, content); a file that isn't a placed raster is an error."""
    ship(files.sparkSession)

    def run(batches) -> Iterator:
        import pandas as pd

        for pdf in batches:
            found = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    found.append((path, *bounds(bytes(content))))
                except (KeyError, ValueError, struct.error) as e:
                    raise ValueError(f"{path}: {e}") from e
            yield pd.DataFrame(found, columns=["path", "left", "bottom", "right", "top"])

    return files.select("path", "content").mapInPandas(run, "path string, left double, bottom double, right double, top double")


def numbered_bounds(files: DataFrame, expected: int | None = None, ws: Workspace | None = None) -> DataFrame:
    """(division, left, bottom, right, top): rasters (path, content) numbered in the order of their paths.

    Any other number of them than ``expected`` is an error.
    """
    ws = ws or Workspace(files.sparkSession)
    out = ws.save(ordinal(tag_bounds(files), [F.col("path")], ws, "division"))
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} rasters instead of {expected}")
    return out.select(F.col("division").cast("int").alias("division"), "left", "bottom", "right", "top")


def raster_bounds(spark: SparkSession, path: str, expected: int | None = 18) -> DataFrame:
    """(division, left, bottom, right, top) of the GeoTIFF files of a folder or pattern."""
    return numbered_bounds(spark.read.format("binaryFile").load(path), expected)
