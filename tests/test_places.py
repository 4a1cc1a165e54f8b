"""Rasters, reference systems and checked bundles."""

import struct

import pytest
from pyspark.sql import functions as F

from gridweave.functions import crs, geo
from gridweave.sources import rasters, sinks


def tiff(w, h, scale=(30.0, 20.0), tie=(0, 0, 0, 100.0, 900.0, 0), order="<", matrix=None, big=False):
    """A TIFF file with a directory and no pixels."""
    mark = b"II" if order == "<" else b"MM"
    fields = [(256, 3, 1, [w]), (257, 4, 1, [h])]
    fields += [(34264, 12, 16, matrix)] if matrix else [(33550, 12, 3, [*(scale or (0, 0)), 0.0])] * bool(scale) + [(33922, 12, 6, list(map(float, tie)))]
    head = struct.pack(order + "2sHHHQ", mark, 43, 8, 0, 16) if big else struct.pack(order + "2sHI", mark, 42, 8)
    size, inline = (20, 8) if big else (12, 4)
    body, data = struct.pack(order + ("Q" if big else "H"), len(fields)), b""
    start = len(head) + len(body) + size * len(fields) + (8 if big else 4)
    for tag, kind, n, values in fields:
        packed = struct.pack(f"{order}{n}{rasters.FORMATS[kind]}", *values)
        body += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, n)
        if len(packed) <= inline:
            body += packed.ljust(inline, b"\0")
        else:
            body += struct.pack(order + ("Q" if big else "I"), start + len(data))
            data += packed
    return head + body + b"\0" * (8 if big else 4) + data


def test_bounds_from_tags():
    for order in "<>":
        for big in (False, True):
            assert rasters.bounds(tiff(10, 5, order=order, big=big)) == (100.0, 800.0, 400.0, 900.0)
    assert rasters.bounds(tiff(10, 5, tie=(2, 1, 0, 160.0, 880.0, 0))) == (100.0, 800.0, 400.0, 900.0)
    turned = [0.0, 2.0, 0.0, 50.0, 3.0, 0.0, 0.0, 70.0] + [0.0] * 7 + [1.0]
    assert rasters.bounds(tiff(4, 6, matrix=turned)) == (50.0, 70.0, 62.0, 82.0)
    for bad in (b"", b"GIF89a--", tiff(4, 6, scale=None)):
        with pytest.raises((ValueError, struct.error)):
            rasters.bounds(bad)


def test_folder_of_rasters(spark, tmp_path):
    for i, name in enumerate(["b.tif", "a.tif", "c.tif"]):
        (tmp_path / name).write_bytes(tiff(10, 5, tie=(0, 0, 0, 100.0 * i, 900.0, 0)))
    out = rasters.raster_bounds(spark, str(tmp_path), 3).orderBy("division").collect()
    assert [(r.division, r.left, r.right) for r in out] == [(0, 100.0, 400.0), (1, 0.0, 300.0), (2, 200.0, 500.0)]
    with pytest.raises(ValueError, match="3 rasters instead of 18"):
        rasters.raster_bounds(spark, str(tmp_path))
    (tmp_path / "d.tif").write_bytes(b"no raster")
    with pytest.raises(Exception, match="d.tif"):
        rasters.raster_bounds(spark, str(tmp_path), 4).collect()


def test_systems_travel_and_are_checked(spark, tmp_path):
    df = crs.tagged(spark.createDataFrame([(1, -74.0, 40.7), (2, -73.9, 40.8)], "k long, x double, y double"), "x", "y", 4326)
    df.write.parquet(str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p")).where("k > 0")
    assert crs.crs_of(back, "x") == 4326 and crs.crs_of(back, "k") is None
    feet = crs.transformed(back, "x", "y", 2263)
    assert crs.crs_of(feet, "y") == 2263
    with pytest.raises(ValueError, match="doesn't meet"):
        crs.aligned(feet, back)
    a, b = crs.aligned(feet, back, to=32618)
    near = sorted((r.k, r.dx, r.dy) for r in a.join(b.select("k", F.col("x").alias("bx"), F.col("y").alias("by")), "k").select("k", (F.col("x") - F.col("bx")).alias("dx"), (F.col("y") - F.col("by")).alias("dy")).collect())
    assert all(abs(dx) < 0.001 and abs(dy) < 0.001 for _, dx, dy in near)
    with pytest.raises(ValueError, match="not EPSG"):
        crs.tagged(feet, "x", "y", 4326)
    assert crs.crs_of(crs.tagged(feet, "x", "y", 4326, override=True), "x") == 4326
    with pytest.raises(ValueError, match="isn't known"):
        crs.transformed(back, "x", "y", 3857)
    lat, lon = geo.state_plane_degrees("x", "y")
    assert [(round(r.a, 8), round(r.b, 8)) for r in feet.orderBy("k").select(lat.alias("a"), lon.alias("b")).collect()] == [(40.7, -74.0), (40.8, -73.9)]


def test_an_altered_bundle_is_caught(spark, tmp_path):
    n = spark.createDataFrame([("power", 0, [1.0, 2.0]), ("fuel", 0, [3.0, 4.0]), ("fuel", 1, None)], "infra_type string, idx int, x array<double>")
    e = spark.createDataFrame([("power", "to", "fuel", [0.5])], "src_type string, relation string, dst_type string, a array<double>")
    path = str(tmp_path / "t")
    assert sinks.write_tensors(n, e, path) == {"nodes": 3, "edges": 1}
    told = {"nodes": {"schema": n.schema, **{k: n.agg(*sinks._contents(n)).first()[k] for k in ("n", "digest")}}}
    sinks.check_tensors(spark, path, told)
    assert sorted(map(tuple, sinks.tensor_summary(spark, path, ["x"], ["a"]).collect())) == [("edges", "power__to__fuel", 1, 1), ("nodes", "fuel", 2, 2), ("nodes", "power", 1, 2)]
    other = n.withColumn("x", F.when(F.col("idx") == 1, F.array(F.lit(9.0))).otherwise(F.col("x")))
    other.write.mode("overwrite").partitionBy("infra_type").parquet(f"{path}/nodes")
    with pytest.raises(OSError, match="nodes"):
        sinks.check_tensors(spark, path, told)
    assert sinks.write_tensors(n.where("false"), e, path) == {"nodes": 0, "edges": 1}
