"""Tiles of points and lines against plain cutting."""

import math
import random

from gridweave.operators import tiles


def _uv(lon, lat, zoom):
    v = 0.5 - math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) / (2 * math.pi)
    return (lon + 180) / 360 * 2**zoom, v * 2**zoom


def test_points(spark):
    df = spark.createDataFrame([("a", 40.7, -74.0), ("b", None, 1.0), ("c", 89.9, 180.0)], "k string, lat double, lon double")
    found = {(r.zoom, r.key): (r.tx, r.ty, r.x, r.y) for r in tiles.point_tiles(df, "k", [0, 12]).collect()}
    assert set(found) == {(z, k) for z in (0, 12) for k in "ac"}
    u, v = _uv(-74.0, 40.7, 12)
    assert found[12, "a"] == (int(u), int(v), int(u % 1 * 4096), int(v % 1 * 4096))
    assert found[12, "c"][:2] == (4095, 0)


def test_pieces_make_the_line_again(spark):
    r = random.Random(2)
    rows = [(i, [[r.uniform(-75, -73), r.uniform(40, 41)] for _ in range(r.randint(2, 5))]) for i in range(40)]
    rows += [(40, [[-74.0, 40.5], [-74.0, 40.9]]), (41, [[-74.0, 40.5]]), (42, None), (43, [[-74.0, 40.5], [-74.0, 40.5]]), (44, [[None, 40.5], [-74.0, 40.5], [-73.5, 40.5]])]
    found = tiles.line_tiles(spark.createDataFrame(rows, "k long, coordinates array<array<double>>"), "k", [5, 10]).collect()
    for zoom in (5, 10):
        for k, line in rows:
            line = [p for p in line or [] if p[0] is not None]
            want = [[round(c * 4096) for c in _uv(*p, zoom)] for p in line]
            long = sum(math.dist(a, b) for a, b in zip(want, want[1:], strict=False))
            own = [x for x in found if x.zoom == zoom and x.key == k]
            got = sum(math.dist((x.x1, x.y1), (x.x2, x.y2)) for x in own)
            assert abs(got - long) <= 1.5 * len(own), (zoom, k)
            assert all(0 <= v <= 4096 for x in own for v in (x.x1, x.y1, x.x2, x.y2))
