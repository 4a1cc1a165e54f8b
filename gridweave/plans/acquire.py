"""From raw feeds to the cleaned layers that the node producers read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.geo import distance, line_meets_box
from gridweave.functions.text import contains_any, first_tag, recode, yes_tags
from gridweave.operators.dedup import keep_nearby_first
from gridweave.operators.tables import box_filter, box_or_wider, first_column, only_columns, union_present
from gridweave.plans.nodes import AREA

# Kinds of water works, fallback margin, and tables that no feed has.
WATER_TYPES = [
    "PUMPING STATION", "WASTEWATER PUMPING STATION", "STORMWATER PUMPING STATION", "WATER POLLUTION CONTROL PLANT",
    "WASTEWATER TREATMENT PLANT", "SLUDGE DE-WATERING FACILITY", "POLLUTION CONTROL FACILITY",
]
CENTRE = (-73.995, 40.725)
PLANTS = [
    ("North River WWTP", 40.7997, -73.9985, 170), ("Newtown Creek WWTP", 40.7367, -73.9388, 310), ("Red Hook WWTP", 40.6729, -74.0097, 60),
    ("26th Ward WWTP", 40.6424, -73.8569, 85), ("Coney Island WWTP", 40.5726, -73.9677, 110), ("Jamaica WWTP", 40.6316, -73.8013, 100),
    ("Tallman Island WWTP", 40.7925, -73.8006, 80), ("Bowery Bay WWTP", 40.7804, -73.8837, 150), ("Hunts Point WWTP", 40.8052, -73.8702, 200),
    ("Wards Island WWTP", 40.7912, -73.9275, 275), ("Oakwood Beach WWTP", 40.5556, -74.1219, 40), ("Port Richmond WWTP", 40.6366, -74.1348, 60),
    ("Rockaway WWTP", 40.5612, -73.8576, 45), ("Owls Head WWTP", 40.6450, -74.0285, 120),
]
TERMINALS = [
    ("Bayonne Terminal Complex", 40.6620, -74.0960, 5_000_000, "gasoline,diesel,jet_fuel"),
    ("Tremley Point Terminal (Linden, NJ)", 40.6280, -74.2200, 3_000_000, "gasoline,diesel"),
    ("Perth Amboy Terminal", 40.5080, -74.2640, 2_000_000, "gasoline,diesel,heating_oil"),
    ("Bronx Terminal (Hunts Point)", 40.8100, -73.8800, 500_000, "gasoline,diesel,heating_oil"),
    ("Brooklyn Terminal (Gowanus)", 40.6730, -73.9900, 1_000_000, "heating_oil,diesel"),
    ("Staten Island Terminal (Howland Hook)", 40.6420, -74.1700, 800_000, "gasoline,diesel"),
]


def hospitals(facilities: DataFrame, area=AREA) -> DataFrame:
    """Full hospitals with a place in the area; clinics and hospices aren't."""
    own = contains_any("FACTYPE", ["HOSPITAL"]) & ~contains_any("FACTYPE", ["EXTENSION CLINIC", "HOSPICE"])
    return box_filter(facilities.where(own).dropna(subset=["LATITUDE", "LONGITUDE"]), area, "LATITUDE", "LONGITUDE")


def facility_water(facilities: DataFrame) -> DataFrame:
    rows = facilities.where(F.col("FACTYPE").isin(WATER_TYPES)).dropna(subset=["LATITUDE", "LONGITUDE"])
    return rows.select("ord", F.col("FACNAME").alias("name"), F.col("LATITUDE").cast("double").alias("lat"), F.col("LONGITUDE").cast("double").alias("lon"), F.col("FACTYPE").alias("type"), F.col("ADDRESS").alias("address"), F.col("BORO").alias("boro"), F.col("OPNAME").alias("operator"), F.lit("facdb").alias("source"))


def mapped_water(elements: DataFrame) -> DataFrame:
    """Water works of map elements (ord, lat, lon, tags)."""
    rows = elements.dropna(subset=["lat", "lon"])
    return rows.select("ord", first_tag("tags", ["name"], "Unknown").alias("name"), "lat", "lon", first_tag("tags", ["man_made", "water_works", "amenity"], "water_works").alias("type"), F.lit("").alias("address"), F.lit("").alias("boro"), first_tag("tags", ["operator"], "").alias("operator"), F.lit("osm").alias("source"))


def listed_plants(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(PLANTS)], "ord int, name string, lat double, lon double, capacity_mgd int")
    return rows.select("ord", "name", "lat", "lon", F.lit("WASTEWATER TREATMENT PLANT").alias("type"), F.lit("").alias("address"), F.lit("").alias("boro"), F.lit("NYC DEP").alias("operator"), F.lit("nyc_dep").alias("source"))


def water(facilities: DataFrame | None, elements: DataFrame | None, plants: DataFrame | None) -> DataFrame:
    """All water works, one a place to three decimals: facilities before maps before the list."""
    rows = union_present([facilities and facility_water(facilities), plants, elements and mapped_water(elements)])
    rank = recode("source", {"facdb": 0, "osm": 1, "nyc_dep": 2}, 3)
    return keep_nearby_first(rows, 3, rank, [F.col("source"), F.col("ord")])


def serving_plants(works: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` treatment plants nearest to the centre, in degrees."""
    own = works.where(F.coalesce(F.col("type").rlike("(?i)TREATMENT|CONTROL PLANT"), F.lit(False)))
    return own.withColumn("dist_to_lm", distance("lon", "lat", F.lit(CENTRE[0]), F.lit(CENTRE[1]))).orderBy("dist_to_lm", "ord").limit(k)


def mapped_stations(elements: DataFrame) -> DataFrame:
    """Fuel stations of map elements, with the fuels that are sold."""
    fuels = yes_tags("tags", "fuel:")
    rows = elements.dropna(subset=["lat", "lon"])
    return rows.select("ord", first_tag("tags", ["name", "brand"], "Gas Station").alias("name"), "lat", "lon", first_tag("tags", ["brand"], "").alias("brand"), first_tag("tags", ["operator"], "").alias("operator"), fuels.alias("fuels"), F.array_contains(F.split(fuels, ","), "diesel").alias("has_diesel"), F.lit("osm").alias("source"))


def served_stations(layer: DataFrame) -> DataFrame:
    """Fuel stations of a service's layer, whichever names its columns have."""
    text = lambda names, default: F.coalesce(first_column(layer, names, default).cast("string"), F.lit(default))
    return layer.select("ord", text(["Name", "FACNAME", "STATION"], "Unknown").alias("name"), F.col("y").alias("lat"), F.col("x").alias("lon"), text(["Brand", "BRAND"], "").alias("brand"), text(["Owner", "OWNER"], "").alias("operator"), F.lit("nys_mapserver").alias("source"))


def stations(layer: DataFrame | None, elements: DataFrame | None) -> DataFrame | None:
    """Fuel stations, one a place to four decimals, the service's before the map's; None without any."""
    schema = ["ord", "name", "lat", "lon", "brand", "operator", "source"]
    rows = union_present([layer and served_stations(layer), elements and only_columns(mapped_stations(elements), schema)])
    return rows and keep_nearby_first(rows, 4, recode("source", {"nys_mapserver": 0, "osm": 1}, 2), [F.col("source"), F.col("ord")])


def listed_terminals(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(TERMINALS)], "ord int, name string, lat double, lon double, capacity_bbl long, products string")
    return rows.withColumn("source", F.lit("hardcoded_nyserda"))


def terminals(spark: SparkSession, layer: DataFrame | None = None) -> DataFrame:
    """Petroleum terminals, one a place to two decimals, the service's before the list's."""
    found = None
    if layer is not None:
        found = layer.select("ord", first_column(layer, ["Terminal_N", "Name", "TERMINAL"], "Unknown Terminal").alias("name"), F.col("y").alias("lat"), F.col("x").alias("lon"), first_column(layer, ["Total_She", "CAPACITY"], 0).cast("long").alias("capacity_bbl"), first_column(layer, ["Products", "PRODUCTS"], "").alias("products"), F.lit("eia").alias("source"))
    rows = union_present([found, listed_terminals(spark)])
    one = keep_nearby_first(rows, 2, recode("source", {"eia": 0, "hardcoded_nyserda": 1}, 2), [F.col("source"), F.col("ord")])
    return one.withColumns({"external": F.lit(True), "type": F.lit("PETROLEUM_TERMINAL")})


def fuel_layer(station_rows: DataFrame, terminal_rows: DataFrame) -> DataFrame:
    """Stations and terminals in one layer; stations have no capacity."""
    s = station_rows.select("name", "lat", "lon", F.lit("fuel").alias("type"), F.lit("GAS_STATION").alias("subtype"), "source", F.lit(False).alias("external"))
    t = terminal_rows.select("name", "lat", "lon", F.lit("fuel").alias("type"), F.lit("PETROLEUM_TERMINAL").alias("subtype"), "source", F.lit(True).alias("external"), F.col("capacity_bbl").cast("double").alias("capacity_bbl"))
    return s.unionByName(t, allowMissingColumns=True)


def area_substations(substations: DataFrame, area=AREA) -> DataFrame:
    """Substations in the area, or slightly around it where there are none."""
    return box_or_wider(substations, area, 0.005, lat="LATITUDE", lon="LONGITUDE")


def area_lines(lines: DataFrame, area=AREA) -> DataFrame:
    """Lines (coordinates: arrays of [lon, lat]) that meet the area."""
    return lines.where(line_meets_box("coordinates", (area[2], area[0], area[3], area[1])))
