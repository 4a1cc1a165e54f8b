"""The unified node table from cleaned layers.

Each producer gives ``producer`` and ``place``, which order all nodes; columns that a kind lacks
are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.geo import utm
from gridweave.functions.text import not_in, recode, slug, station_label, title
from gridweave.operators.dedup import cluster_towers, keep_first, merge_stations, numbered
from gridweave.operators.joins import endpoints_missing, farther_than, lookup_last
from gridweave.operators.tables import external_flag, union_all

# Operators by (mcc, net) and the box of the study area.
OPERATORS = {"310/260": "T-Mobile", "310/410": "AT&T", "310/240": "T-Mobile Metro"}
AREA = (40.700, 40.755, -74.020, -73.970)


def node(producer: int, place: Column, kind: str, **columns) -> list[Column]:
    return [F.lit(producer).alias("producer"), place.alias("place"), F.lit(kind).alias("infra_type"), *[c.alias(n) for n, c in columns.items()]]


def operator(mcc, net) -> Column:
    code = F.concat_ws("/", F.col(mcc).cast("string"), F.col(net).cast("string"))
    return F.coalesce(recode(code, OPERATORS), code)


def power_nodes(substations: DataFrame) -> DataFrame:
    return substations.select(*node(0, F.struct(F.col("ord").cast("long").alias("a"), F.lit(0).cast("long").alias("b")), "power", node_id=F.concat(F.lit("power_"), slug("NAME")), name=title("NAME"), subtype=F.col("TYPE"), lat=F.col("LATITUDE").cast("double"), lon=F.col("LONGITUDE").cast("double"), status=F.col("STATUS"), external=F.lit(False)))


def external_power_nodes(lines: DataFrame, substations: DataFrame, city: DataFrame) -> DataFrame:
    """Line ends that aren't local substations, in the order they appear, placed by the city's file."""
    found = endpoints_missing(lines, substations, ["SUB_1", "SUB_2"], "NAME", "ord")
    named = lookup_last(found, city, F.trim("name"), F.upper("NAME"), "ord", ["LATITUDE", "LONGITUDE"])
    place = F.struct(F.col("ord.o").cast("long").alias("a"), F.col("ord.i").cast("long").alias("b"))
    return named.select(*node(1, place, "power", node_id=F.concat(F.lit("power_"), slug(F.trim("name"))), name=title(F.trim("name")), subtype=F.lit("SUBSTATION"), lat=F.col("LATITUDE").cast("double"), lon=F.col("LONGITUDE").cast("double"), status=F.lit("EXTERNAL"), external=F.lit(True)))


def _at(c) -> Column:
    return F.struct(F.col(c).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))


def telecom_nodes(towers: DataFrame, ws, step: float = 0.005) -> DataFrame:
    clusters = cluster_towers(towers.withColumn("operator", operator("mcc", "net")), step)
    rows = numbered(clusters, [F.col("operator"), F.col("cell_lat"), F.col("cell_lon")], "telecom_cluster_%04d", ws)
    place = F.struct(F.regexp_extract("node_id", r"(\d+)$", 1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    return rows.select(*node(2, place, "telecom", node_id=F.col("node_id"), name=F.concat("operator", F.lit(" cluster")), subtype=F.lit("CELL_CLUSTER"), lat=F.col("lat"), lon=F.col("lon"), tower_count=F.col("tower_count"), radio_types=F.col("radio_types"), operator=F.col("operator"), external=F.lit(False)))


def hospital_nodes(hospitals: DataFrame) -> DataFrame:
    """One per place: the first kind of facility by name."""
    one = keep_first(hospitals, ["LATITUDE", "LONGITUDE"], [F.col("FACTYPE"), F.col("ord")])
    place = F.struct(F.lit(0).cast("long").alias("a"), F.col("ord").cast("long").alias("b"))
    return one.select(*node(3, place, "hospital", node_id=F.concat(F.lit("hospital_"), slug(F.substring("FACNAME", 1, 30))), name=title("FACNAME"), subtype=F.col("FACTYPE"), lat=F.col("LATITUDE").cast("double"), lon=F.col("LONGITUDE").cast("double"), address=F.col("ADDRESS"), external=F.lit(False)))


def subway_nodes(stations: DataFrame) -> DataFrame:
    """``stations``: ord, lat, lon, stop_name, routes, ada, division."""
    one = merge_stations(stations, ["lat", "lon"], ["stop_name", "division"], "ada", "routes", "ord")
    return one.select(*node(4, _at("ord"), "subway", node_id=F.concat_ws("_", F.lit("subway"), slug("stop_name"), slug(F.replace("routes", F.lit(" ")))), name=F.col("stop_name"), subtype=F.lit("STATION"), lat=F.col("lat"), lon=F.col("lon"), routes=F.col("routes"), ada=F.col("ada").cast("long"), external=F.lit(False)))


def water_nodes(local: DataFrame, serving: DataFrame, exclude: list[str], apart: float = 50.0) -> DataFrame:
    """Local works, and plants that serve the area unless a local one is within ``apart`` metres."""
    order = [F.col("ord")]
    a = keep_first(local.where(not_in("name", exclude)), ["lat", "lon"], order).withColumns({"external": F.lit(False), "part": F.lit(0)})
    b = keep_first(serving, ["lat", "lon"], order).withColumns({"external": F.lit(True), "part": F.lit(1)})
    xy = lambda df: df.withColumns(dict(zip(("x", "y"), utm("lat", "lon"), strict=True)))
    rows = union_all([a, farther_than(xy(b), xy(a), apart, "ord").drop("x", "y")])
    place = F.struct(F.col("part").cast("long").alias("a"), F.col("ord").cast("long").alias("b"))
    return rows.select(*node(5, place, "water", node_id=F.concat(F.lit("water_"), slug(F.substring("name", 1, 35))), name=title("name"), subtype=F.col("type"), lat=F.col("lat"), lon=F.col("lon"), operator=F.col("operator"), external=F.col("external")))


def station_nodes(stations: DataFrame, area=AREA) -> DataFrame:
    rows = external_flag(stations, area)
    name = F.coalesce("name", F.lit("Gas Station"))
    return rows.select(*node(6, _at("ord"), "fuel", node_id=F.concat(F.lit("fuel_station_"), slug(name), F.format_string("_%03d", F.col("ord"))), name=station_label(name, "brand"), subtype=F.lit("GAS_STATION"), lat=F.col("lat"), lon=F.col("lon"), brand=F.col("brand"), external=F.col("external")))


def terminal_nodes(terminals: DataFrame) -> DataFrame:
    return terminals.select(*node(7, _at("ord"), "fuel", node_id=F.concat(F.lit("fuel_terminal_"), slug(F.substring("name", 1, 35))), name=F.col("name"), subtype=F.lit("PETROLEUM_TERMINAL"), lat=F.col("lat"), lon=F.col("lon"), capacity_bbl=F.coalesce(F.col("capacity_bbl").cast("long"), F.lit(0).cast("long")), external=F.lit(True)))


def unified(producers: list[DataFrame], ws) -> DataFrame:
    """All nodes with ``ord``, each id once: the first producer's first row."""
    from gridweave.operators.ordering import ordinal

    one = keep_first(union_all(producers), ["node_id"], [F.col("producer"), F.col("place")])
    return ordinal(one, [F.col("producer"), F.col("place"), F.col("node_id")], ws).drop("producer", "place")
