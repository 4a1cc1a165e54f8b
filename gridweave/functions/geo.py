"""Coordinates as column expressions: projections, distances, boxes and polygons.

Points are two doubles, lines arrays of [x, y], polygons arrays of rings.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.workspace import ship

# The WGS84/GRS80 ellipsoid and the series of the transverse Mercator projection (Karney 2011).
ECCENTRICITY = 0.08181919084262149
RECTIFYING_RADIUS = 6367449.145823415
ALPHA = (8.377318206244698e-4, 7.608527773572307e-7)
BETA = (8.377321640579487e-4, 5.905870222038e-8)
SCALE, FALSE_EASTING, UTM18_MERIDIAN = 0.9996, 500000.0, -75.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _mercator(phi, lam, m, atan2):
    """(easting, northing) of radians from the central meridian, with the functions of ``m``: Spark's, or others for arrays."""
    t = m.sinh(m.atanh(m.sin(phi)) - m.atanh(m.sin(phi) * ECCENTRICITY) * ECCENTRICITY)
    xi, eta = atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(t * t + 1))
    x, y = eta, xi
    for k, a in enumerate(ALPHA, 1):
        x = x + m.cos(xi * 2 * k) * a * m.sinh(eta * 2 * k)
        y = y + m.sin(xi * 2 * k) * a * m.cosh(eta * 2 * k)
    return x * (SCALE * RECTIFYING_RADIUS) + FALSE_EASTING, y * (SCALE * RECTIFYING_RADIUS)


def utm(lat, lon, meridian: float = UTM18_MERIDIAN) -> tuple[Column, Column]:
    """(easting, northing) in metres of degrees; zone 18 north by default."""
    return _mercator(F.radians(col(lat)), F.radians(col(lon) - F.lit(meridian)), F, F.atan2)


def with_utm_to_the_bit(df: DataFrame, lat: str = "lat", lon: str = "lon", meridian: float = UTM18_MERIDIAN) -> DataFrame:
    """Rows with ``x`` and ``y``: ``utm`` by the functions of the C library, as SQL engines have them.

    Java's differ from those in the last bits, a few nanometres. A thousand million distances that are rounded to metres
    have some so near a half that it shows. Rows are dealt to all tasks, since a small file is read by one.
    """

    def places(lats, lons):
        import numpy as np
        import pyarrow as pa

        def each(f):
            def one(v, *w):
                try:
                    return f(v, *w)
                except OverflowError:
                    return math.inf if f is math.cosh else math.copysign(math.inf, v)
                except ValueError:  # atanh at 1 is infinite; all else has no value
                    return math.copysign(math.inf, v) if abs(v) == 1 else math.nan

            return lambda *a: np.fromiter(map(one, *(x.tolist() for x in a)), float, len(a[0]))

        known = [v.to_numpy(zero_copy_only=False).astype(float) for v in (lats, lons)]
        own = SimpleNamespace(sqrt=np.sqrt, **{n: each(getattr(math, n)) for n in ("sin", "cos", "sinh", "cosh", "atanh")})
        with np.errstate(all="ignore"):
            found = _mercator(known[0] * (math.pi / 180), (known[1] - meridian) * (math.pi / 180), own, each(math.atan2))
        none = np.array(lats.is_null()) | np.array(lons.is_null())
        return pa.StructArray.from_arrays([pa.array(v, mask=none) for v in found], names=["x", "y"])

    ship(df.sparkSession)
    once = F.arrow_udf(places, "struct<x double, y double>").asNondeterministic()  # else a filter on places would have them computed twice, before rows are dealt
    both = once(F.col(lat).cast("double"), F.col(lon).cast("double"))
    return df.repartition(*df.columns).withColumn("_xy", both).withColumns({"x": F.col("_xy.x"), "y": F.col("_xy.y")}).drop("_xy")


def _latitude(chi: Column) -> Column:
    """Latitude of a conformal latitude, in radians, by its series in the eccentricity."""
    e2 = ECCENTRICITY**2
    d = (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120)
    phi = chi
    for k, c in enumerate(d, 1):
        phi = phi + F.lit(c) * F.sin(chi * 2 * k)
    return phi


def utm_inverse(x, y, meridian: float = UTM18_MERIDIAN) -> tuple[Column, Column]:
    """(lat, lon) in degrees of UTM metres north of the equator."""
    r = SCALE * RECTIFYING_RADIUS
    xi, eta = col(y) / F.lit(r), (col(x) - FALSE_EASTING) / F.lit(r)
    xi0, eta0 = xi, eta
    for k, b in enumerate(BETA, 1):
        xi0 = xi0 - F.lit(b) * F.sin(xi * 2 * k) * F.cosh(eta * 2 * k)
        eta0 = eta0 - F.lit(b) * F.cos(xi * 2 * k) * F.sinh(eta * 2 * k)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    return F.degrees(_latitude(chi)), F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))) + F.lit(meridian)


# EPSG:2263, New York Long Island in US survey feet (Lambert conformal conic, two parallels).
LCC_PARALLELS, LCC_ORIGIN = (40 + 40 / 60, 41 + 2 / 60), (40 + 10 / 60, -74.0)
LCC_EASTING_M, FOOT, SEMI_MAJOR = 300000.0, 1200 / 3937, 6378137.0


def _lcc_t(phi: float) -> float:
    s = ECCENTRICITY * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (ECCENTRICITY / 2)


def _lcc_constants() -> tuple[float, float, float]:
    """(cone, scaled radius, radius of the origin), in metres."""
    p1, p2 = (math.radians(p) for p in LCC_PARALLELS)
    m = [math.cos(p) / math.sqrt(1 - (ECCENTRICITY * math.sin(p)) ** 2) for p in (p1, p2)]
    n = math.log(m[0] / m[1]) / math.log(_lcc_t(p1) / _lcc_t(p2))
    big_f = m[0] / (n * _lcc_t(p1) ** n)
    return n, SEMI_MAJOR * big_f, SEMI_MAJOR * big_f * _lcc_t(math.radians(LCC_ORIGIN[0])) ** n


def state_plane_degrees(x, y) -> tuple[Column, Column]:
    """(lat, lon) in degrees of EPSG:2263 feet."""
    n, scaled, rho0 = _lcc_constants()
    mx, my = col(x) * F.lit(FOOT) - LCC_EASTING_M, F.lit(rho0) - col(y) * F.lit(FOOT)
    t = F.pow(F.sqrt(mx * mx + my * my) / scaled, F.lit(1 / n))
    chi = F.lit(math.pi / 2) - F.atan(t) * 2
    return F.degrees(_latitude(chi)), F.degrees(F.atan2(mx, my) / n) + F.lit(LCC_ORIGIN[1])


def state_plane_feet(lat, lon) -> tuple[Column, Column]:
    """(x, y) in EPSG:2263 feet of degrees (Snyder 1987)."""
    n, scaled, rho0 = _lcc_constants()
    phi = F.radians(col(lat))
    s = F.sin(phi) * ECCENTRICITY
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (s + 1), F.lit(ECCENTRICITY / 2))
    rho = F.pow(t, F.lit(n)) * scaled
    theta = F.radians(col(lon) - F.lit(LCC_ORIGIN[1])) * n
    return (rho * F.sin(theta) + LCC_EASTING_M) / FOOT, (F.lit(rho0) - rho * F.cos(theta)) / FOOT


def distance(x1, y1, x2, y2) -> Column:
    """Planar distance."""
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return F.sqrt(dx * dx + dy * dy)


def in_box(lat, lon, box: Sequence[float]) -> Column:
    """Inside (lat_min, lat_max, lon_min, lon_max), edges included; null coordinates give null."""
    a, b, c, d = box
    return col(lat).between(F.lit(a), F.lit(b)) & col(lon).between(F.lit(c), F.lit(d))


def widened(box: Sequence[float], by: float) -> tuple[float, float, float, float]:
    return box[0] - by, box[1] + by, box[2] - by, box[3] + by


def half_even(v, decimals: int) -> Column:
    """Rounded to decimals as floats are, halves to even: what is a half once multiplied counts as one, though its decimal digits end below it."""
    scale = F.lit(10.0**decimals)
    scaled = F.rint(col(v) * scale)
    return F.when(F.abs(scaled) == float("inf"), col(v).cast("double")).otherwise(scaled / scale)


def half_away(v, decimals: int) -> Column:
    """Rounded to decimals as floats are, halves away from zero; no decimal digits are made, so it costs little for very many rows."""
    scale = 10.0**decimals
    scaled = F.abs(col(v)) * scale
    low = F.floor(scaled).cast("double")
    whole = F.when(scaled - low >= 0.5, low + 1.0).otherwise(low)
    return F.when(scaled < float(1 << 52), F.signum(col(v)) * whole / scale).otherwise(col(v).cast("double"))


def cell(v, step: float) -> Column:
    """Number of the grid cell whose centre is nearest, halves to even."""
    return F.rint(col(v) / F.lit(step)).cast("long")


def point(x, y) -> Column:
    return F.array(col(x).cast("double"), col(y).cast("double"))


def line(*points) -> Column:
    return F.array(*points)


def swap_axes(coordinates) -> Column:
    """[x, y] pairs as [y, x]."""
    return F.transform(col(coordinates), lambda c: F.array(F.get(c, 1), F.get(c, 0)))


def midpoint(a, b) -> Column:
    return (col(a) + col(b)) / 2


def segment_meets_box(x1, y1, x2, y2, left, bottom, right, top) -> Column:
    """Whether a segment has a point in a box, edges included (Liang-Barsky)."""
    x1, y1, x2, y2, left, bottom, right, top = (col(c) if not isinstance(c, (int, float)) else F.lit(float(c)) for c in (x1, y1, x2, y2, left, bottom, right, top))
    lo, hi, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((x1 - x2, x1 - left), (x2 - x1, right - x1), (y1 - y2, y1 - bottom), (y2 - y1, top - y1)):
        r = F.try_divide(q, p)
        lo = F.when(p < 0, F.greatest(lo, r)).otherwise(lo)
        hi = F.when(p > 0, F.least(hi, r)).otherwise(hi)
        ok = ok & ((p != 0) | (q >= 0))
    return ok & (lo <= hi)


def line_meets_box(coordinates, box: Sequence[float]) -> Column:
    """Whether an array of [x, y] meets (left, bottom, right, top); a lone point counts."""
    c = col(coordinates)
    segments = F.zip_with(c, F.slice(c, 2, F.size(c)), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, a).alias("b")))
    return F.exists(segments, lambda s: segment_meets_box(F.get(s["a"], 0), F.get(s["a"], 1), F.get(s["b"], 0), F.get(s["b"], 1), *box))


def rings_to_segments(rings) -> Column:
    """Segments of all rings of a polygon (array of arrays of [x, y]); rings close themselves."""
    one = lambda r: F.zip_with(r, F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)), lambda a, b: F.struct(F.get(a, 0).alias("x1"), F.get(a, 1).alias("y1"), F.get(b, 0).alias("x2"), F.get(b, 1).alias("y2")))
    return F.flatten(F.transform(col(rings), one))


def inside_segments(x, y, segments) -> Column:
    """Even-odd rule: whether a ray to the right crosses an odd number of segments."""
    px, py = col(x), col(y)

    def crosses(s):
        cut = s["x1"] + (py - s["y1"]) * F.try_divide(s["x2"] - s["x1"], s["y2"] - s["y1"])
        return F.when(((s["y1"] > py) != (s["y2"] > py)) & (px < cut), 1).otherwise(0)

    return F.aggregate(col(segments), F.lit(0), lambda n, s: n + crosses(s)) % 2 == 1
