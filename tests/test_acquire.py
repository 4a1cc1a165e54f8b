from pyspark.sql import functions as F

from gridweave.functions import text
from gridweave.operators import graph
from gridweave.plans import acquire
from gridweave.sources import pages


def test_hospitals_and_water(spark):
    rows = [(0, "A", "ACUTE CARE HOSPITAL", 40.71, -74.0), (1, "B", "HOSPITAL EXTENSION CLINIC", 40.71, -74.0), (2, "C", None, 40.71, -74.0), (3, "D", "Hospital", None, None), (4, "E", "HOSPITAL", 41.5, -74.0), (5, "W", "PUMPING STATION", 40.7367, -73.9388)]
    f = spark.createDataFrame(rows, "ord int, FACNAME string, FACTYPE string, LATITUDE double, LONGITUDE double").withColumns({c: F.lit("x") for c in ("ADDRESS", "BORO", "OPNAME")})
    assert [r.FACNAME for r in acquire.hospitals(f).collect()] == ["A"]
    works = acquire.water(f, None, acquire.listed_plants(spark))
    assert works.count() == 14 and {r.name for r in works.where("lat = 40.7367").collect()} == {"W"}
    assert [r.name for r in acquire.serving_plants(works, 2).collect()] == ["Red Hook WWTP", "North River WWTP"]


def test_fuel(spark):
    tags = F.create_map(F.lit("brand"), F.lit("Q"), F.lit("fuel:diesel"), F.lit("yes"))
    e = spark.createDataFrame([(0, 40.71, -74.0), (1, 40.72, -74.0), (2, None, None)], "ord int, lat double, lon double").withColumn("tags", tags)
    m = acquire.mapped_stations(e).collect()
    assert [(r.name, r.fuels, r.has_diesel) for r in m] == [("Q", "diesel", True)] * 2
    layer = spark.createDataFrame([(0, "S", -74.00001, 40.71001)], "ord int, FACNAME string, x double, y double")
    s = acquire.stations(layer, e)
    assert {(r.name, r.source) for r in s.collect()} == {("S", "nys_mapserver"), ("Q", "osm")}
    assert acquire.stations(None, None) is None
    t = acquire.terminals(spark, spark.createDataFrame([(0, "T", -74.096, 40.662, 9)], "ord int, Name string, x double, y double, CAPACITY int"))
    assert t.count() == 6 and t.where("name = 'T'").first().capacity_bbl == 9
    both = acquire.fuel_layer(s, t)
    assert both.count() == 8 and both.where("capacity_bbl is null").count() == 2


def test_power_area(spark):
    s = spark.createDataFrame([("n", 40.758, -74.0)], "NAME string, LATITUDE double, LONGITUDE double")
    assert acquire.area_substations(s).count() == 1
    lines = spark.createDataFrame([([[-75.0, 40.72], [-73.0, 40.72]],), ([[-75.0, 41.0], [-73.0, 41.0]],)], "coordinates array<array<double>>")
    assert acquire.area_lines(lines).count() == 1


def test_labels_lines_and_download(spark, tmp_path):
    r = spark.range(1).select(text.thousands(F.lit(1234567)).alias("a"), text.percent(F.lit(1), F.lit(8)).alias("b"), text.percent(F.lit(1), F.lit(0)).alias("c")).first()
    assert (r.a, r.b, r.c) == ("1,234,567", "12.5%", "0.0%")
    n = spark.createDataFrame([("x", 1, "B A"), ("y", 0, "A"), ("z", 2, None)], "node_id string, ord int, routes string")
    assert {r.line: r.stations for r in graph.stations_by_line(n).collect()} == {"A": ["y", "x"], "B": ["x"]}
    (tmp_path / "a").write_bytes(b"z" * 20000)
    assert pages.download((tmp_path / "a").as_uri(), str(tmp_path / "b")) == 20000
