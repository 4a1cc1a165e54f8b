import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridweave.functions import geo, text


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_slug_and_title(spark):
    r = one(spark, s=text.slug(F.lit("Kinder Morgan (Carteret, NJ) - Pier/O'Neil")), t=text.title(F.lit("EAST 13TH st-o'hara")))
    assert r.s == "kinder_morgan_carteret_nj___pier_oneil" and r.t == "East 13Th St-O'Hara"


def test_tolerant_values(spark):
    rows = [("1.5", " TRUE "), ("nan", "yes"), (None, None), ("x", "0"), ("", "1")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(text.safe_double("a", -1.0).alias("a"), text.tolerant_bool("b").alias("b")).collect()
    assert [r.a for r in got] == [1.5, -1.0, -1.0, -1.0, -1.0]
    assert [r.b for r in got] == [True, True, False, False, True]
    labels = spark.createDataFrame([("3",), ("-1",), ("4.0",), ("x",), (None,)], "d string").select(text.division_label("d").alias("d"))
    assert [r.d for r in labels.collect()] == ["3", "external", "4", "—", "—"]


def test_tags_and_tokens(spark):
    tags = F.create_map(F.lit("fuel:diesel"), F.lit("yes"), F.lit("fuel:e85"), F.lit("no"), F.lit("brand"), F.lit("B"))
    r = one(spark, y=text.yes_tags(tags, "fuel:"), b=text.first_tag(tags, ["name", "brand"], "z"), n=text.first_tag(tags, ["none"], "z"), t=text.token_count(F.lit("  a b  c ")), e=text.token_count(F.lit(None).cast("string")), m=text.merged_tokens(F.array(F.lit("N Q R"), F.lit("A N"), F.lit(None).cast("string"))))
    assert (r.y, r.b, r.n, r.t, r.e, r.m) == ("diesel", "B", "z", 3, 0, "A N Q R")


def test_colours_and_popups(spark):
    r = one(spark, a=text.depth_colour(F.lit(0.0)), b=text.depth_colour(F.lit(9.0)), c=text.depth_radius(F.lit(1.0)), p=text.popup([F.lit("x"), text.segment("A:", F.lit("nan")), text.segment("B:", F.lit(2))]))
    assert (r.a, r.b, r.c, r.p) == ("#C6DBEF", "#08306B", 18, "x<br><b>B:</b> 2")


def test_state_plane_origin_and_scale(spark):
    x, y = geo.state_plane_feet(F.lit(40 + 10 / 60), F.lit(-74.0))
    r = one(spark, x=x, y=y)
    assert math.isclose(r.x, 984250.0, abs_tol=0.01) and math.isclose(r.y, 0.0, abs_tol=0.01)
    a, b = geo.state_plane_feet(F.lit(40.7), F.lit(-74.0)), geo.state_plane_feet(F.lit(40.71), F.lit(-74.0))
    r = one(spark, d=b[1] - a[1])
    assert math.isclose(r.d * 1200 / 3937, 1110.6, abs_tol=0.5)


def test_utm_known_point(spark):
    x, y = geo.utm(F.lit(0.0), F.lit(-75.0))
    r = one(spark, x=x, y=y)
    assert math.isclose(r.x, 500000.0, abs_tol=1e-6) and math.isclose(r.y, 0.0, abs_tol=1e-6)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=3, max_size=7, unique=True), st.integers(0, 20), st.integers(0, 20))
def test_even_odd_rule(spark_once, ring, px, py):
    px, py = px + 0.37, py + 0.41
    n, inside = len(ring), False
    for k in range(n):
        (x1, y1), (x2, y2) = ring[k], ring[(k + 1) % n]
        if (y1 > py) != (y2 > py) and px < x1 + (py - y1) * ((x2 - x1) / (y2 - y1)):
            inside = not inside
    rings = F.array(F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ring]))
    assert one(spark_once, i=geo.inside_segments(F.lit(px), F.lit(py), geo.rings_to_segments(rings))).i == inside


def test_segment_and_box(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    meets = lambda *p: one(spark, m=geo.segment_meets_box(*[F.lit(float(v)) for v in p], *box)).m
    assert meets(-1, 0.5, 2, 0.5) and meets(0.2, 0.2, 0.3, 0.3) and meets(1, 1, 2, 2) and meets(0.5, 0.5, 0.5, 0.5)
    assert not meets(-1, 2, 2, 2) and not meets(1.5, -1, 3, 2) and not meets(2, 2, 2, 2)


def test_box_edges_and_widening(spark):
    df = spark.createDataFrame([(40.7, -74.0), (None, -74.0), (40.8, -74.0)], "lat double, lon double")
    from gridweave.operators import tables

    assert tables.box_filter(df, (40.7, 40.75, -74.0, -73.9)).count() == 1
    assert tables.box_or_wider(df, (40.71, 40.75, -74.0, -73.9), 0.02).count() == 1
    assert [r.external for r in tables.external_flag(df, (40.7, 40.75, -74.0, -73.9)).collect()] == [False, True, True]


def test_places_to_the_bit_as_in_sql(spark):
    """Java's functions differ in the last bits, so one of 1,506,506,691 distances was rounded to another metre than SQL's."""
    import duckdb

    from gridweave.queries import _utm_sql

    places = [(40.7 + i * 7919 % 5501 / 1e5, -74.02 + i * 104729 % 5003 / 1e5) for i in range(3000)] + [(-12.5, 3.0), (0.0, -75.0), (61.25, -80.5)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "key long, lat double, lon double")
    duck = duckdb.connect()
    duck.register("given", df.toPandas())
    want = {r[0]: r[1:] for r in duck.execute(f"WITH base AS (SELECT * FROM given), {_utm_sql('lat', 'lon')} SELECT key, x, y FROM placed").fetchall()}
    assert {r.key: (r.x, r.y) for r in geo.with_utm_to_the_bit(df).collect()} == want
    odd = spark.createDataFrame([(1, None, 2.0), (2, 90.0, 2.0), (3, float("inf"), 2.0), (4, 40.0, 15.0)], "key long, lat double, lon double")
    got = {r.key: (r.x, r.y) for r in geo.with_utm_to_the_bit(odd).collect()}
    plain = odd.select("key", *[c.alias(n) for c, n in zip(geo.utm("lat", "lon"), "xy", strict=True)])
    assert got.pop(1) == (None, None)
    for k, x, y in plain.where("key > 1").collect():
        assert all(g == w or math.isnan(g) and math.isnan(w) or math.isclose(g, w) for g, w in zip(got[k], (x, y), strict=True)), k


def test_halves_go_away_from_zero(spark):
    values = [0.0005, -0.0005, 0.1235, 2.0, 1e300, 0.0, float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.r for r in df.select(geo.half_away("v", 3).alias("r")).collect()] == [0.001, -0.001, 0.124, 2.0, 1e300, 0.0, float("inf"), None]
