"""Edges between infrastructure nodes: lines, dependencies, flows, supplies and access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.geo import distance, utm, with_utm_to_the_bit
from gridweave.functions.text import present, recode, slug, tokens
from gridweave.functions.weights import inverse_distance, kilometres, whole_metres
from gridweave.operators.dedup import last_write_wins
from gridweave.operators.graph import consecutive_pairs
from gridweave.operators.joins import closed_edges, nearest, with_ends, within_radius
from gridweave.operators.tables import both_ways, union_all
from gridweave.workspace import Workspace

# Hours of buffer, line weights by voltage, kinds of water works, radii and thresholds.
BUFFER_HOURS = {"telecom": 6.0, "hospital": 96.0, "subway": 0.0, "water": 3.0, "fuel": 0.0}
TERMINAL_POWER, SCADA, WATER_SUPPLY = 4.0, 2.0, 24.0
FUEL_TO = {"hospital": 96.0, "telecom": 48.0, "water": 48.0}
VOLT_WEIGHT = {"345": 3.0, "100-161": 1.5, "NOT AVAILABLE": 1.0}
PUMPS = ["PUMPING STATION", "WASTEWATER PUMPING STATION", "STORMWATER PUMPING STATION"]
PLANTS = ["WATER POLLUTION CONTROL PLANT", "WASTEWATER TREATMENT PLANT"]
FLOW_METRES, SERVED_TOWERS = 5000.0, 5


def projected(nodes: DataFrame) -> DataFrame:
    x, y = utm("lat", "lon")
    ok = present("lat") & present("lon")
    return nodes.withColumns({"x": F.when(ok, x), "y": F.when(ok, y)})


def waters(nodes: DataFrame) -> DataFrame:
    """Placed water works; their pairs are so many that places are taken to the last bit."""
    own = nodes.where("infra_type = 'water'").where(present("lat") & present("lon"))
    return with_utm_to_the_bit(own.select("node_id", "infra_type", "ord", "subtype", "lat", "lon")).drop("lat", "lon")


def _edge(df: DataFrame, kind: str, rank: int, **columns: Column) -> DataFrame:
    return df.select("u", "v", F.lit(kind).alias("edge_type"), *[c.alias(n) for n, c in columns.items()], F.lit(rank).alias("rank"), F.col("at"))


def _at(*parts) -> Column:
    return F.array(*[F.col(p).cast("long") if isinstance(p, str) else p.cast("long") for p in parts])


def power_lines(lines: DataFrame) -> DataFrame:
    """Both ways, weighted by voltage; ends are upper-cased but not trimmed."""
    end = lambda c: F.concat(F.lit("power_"), slug(F.upper(c)))
    rows = lines.select(end("SUB_1").alias("u"), end("SUB_2").alias("v"), "VOLT_CLASS", "TYPE", "ord")
    rows = both_ways(rows).withColumn("at", _at("ord", "way", F.lit(0)))
    return _edge(rows, "power_line", 1, weight=recode("VOLT_CLASS", VOLT_WEIGHT, 1.0), volt_class=F.col("VOLT_CLASS"), line_type=F.col("TYPE"), buffer_hours=F.lit(0.0))


def subway_lines(nodes: DataFrame) -> DataFrame:
    """Both ways between neighbours along each line; lines in order of their first station."""
    s = nodes.where("infra_type = 'subway'").select("node_id", "ord", "lat", "lon", "x", "y", F.posexplode(tokens("routes")).alias("route", "line"))
    first = s.groupBy("line").agg(F.min(F.struct("ord", "route")).alias("line_at"))
    pairs = with_ends(consecutive_pairs(s), s.select("node_id", "x", "y").distinct(), ["x", "y"])
    pairs = pairs.join(first, "line").withColumn("d", distance("u_x", "u_y", "v_x", "v_y"))
    rows = both_ways(pairs.select("u", "v", "line", "d", "step", "line_at"))
    rows = rows.withColumn("at", _at("line_at.ord", F.col("line_at.route") * 1_000_000 + F.col("step"), "way"))
    return _edge(rows, "subway_line", 2, weight=kilometres("d"), line=F.col("line"), distance_m=whole_metres("d"), buffer_hours=F.lit(0.0))


def nearest_edges(sources: DataFrame, targets: DataFrame, kind: str, rank: int, buffer: Column, dependency: str, layer: str | None = None, ws=None) -> DataFrame:
    """An edge from the nearest source to every target, weighted by inverse distance."""
    s = sources.select(F.col("node_id").alias("u"), "ord", "x", "y")
    t = targets.select(F.col("node_id").alias("v"), F.col("ord").alias("t_ord"), "infra_type", "x", "y")
    found = nearest(t, s, "v", "u", "ord", ws=ws)
    rows = found.where("u <> v").join(t.select("v", "t_ord", "infra_type"), "v").withColumn("at", _at("t_ord", F.lit(0), F.lit(0)))
    return _edge(rows, kind, rank, weight=inverse_distance("metres"), distance_m=whole_metres("metres"), buffer_hours=buffer, dependency_class=F.lit(dependency), layer=F.lit(layer).cast("string"))


def water_flow(nodes: DataFrame, plants: DataFrame | None = None, ws=None) -> DataFrame:
    """From every pump to every treatment plant within reach; plants are among ``nodes`` unless given apart."""
    water = lambda df, kinds: df.where((F.col("infra_type") == "water") & F.col("subtype").isin(kinds)).select("node_id", "ord", "x", "y")
    pairs = within_radius(water(nodes, PUMPS), water(nodes if plants is None else plants, PLANTS), FLOW_METRES, ws=ws)
    rows = pairs.select(F.col("l_node_id").alias("u"), F.col("r_node_id").alias("v"), "metres", _at("l_ord", "r_ord", F.lit(0)).alias("at"))
    return _edge(rows, "water_flow", 5, weight=kilometres("metres"), distance_m=whole_metres("metres"), buffer_hours=F.lit(0.0), dependency_class=F.lit("physical"))


def edge_producers(nodes: DataFrame, lines: DataFrame, ws=None) -> dict[str, Callable[[], DataFrame]]:
    """What makes every producer's edges, by its name, in the order in which they are written."""
    n = projected(nodes)
    has = n.where("x is not null")
    kind = lambda *k: has.where(F.col("infra_type").isin(*k))
    local = lambda df: df.where(~F.coalesce("external", F.lit(False)))
    power, telecom, subway, hospital, water = local(kind("power")), kind("telecom"), kind("subway"), kind("hospital"), kind("water")
    terminals, stations = kind("fuel").where("subtype = 'PETROLEUM_TERMINAL'"), kind("fuel").where("subtype = 'GAS_STATION'")
    dependents = local(kind("hospital", "water", "telecom", "subway", "fuel"))
    served = telecom.where(F.coalesce("tower_count", F.lit(0)) >= SERVED_TOWERS)
    zero = F.lit(0.0)
    return {
        "power_lines": lambda: power_lines(lines),
        "subway_lines": lambda: subway_lines(n),
        "power_dependents": lambda: nearest_edges(power, dependents, "power_dependency", 3, recode("infra_type", BUFFER_HOURS, 0.0), "physical", ws=ws),
        "power_terminals": lambda: nearest_edges(power, terminals, "power_dependency", 4, F.lit(TERMINAL_POWER), "physical", ws=ws),
        "water_flow": lambda: water_flow(waters(nodes), ws=ws),
        "water_supplies": lambda: nearest_edges(water, hospital, "water_supplies", 6, F.lit(WATER_SUPPLY), "physical", ws=ws),
        "scada": lambda: nearest_edges(telecom, power, "scada_monitoring", 7, F.lit(SCADA), "cyber", ws=ws),
        "repair_access": lambda: nearest_edges(subway, local(kind("power", "hospital", "water", "telecom", "fuel")), "repair_access", 8, zero, "logical", "recovery", ws=ws),
        "fuel_distribution": lambda: nearest_edges(terminals, stations, "fuel_distribution", 9, zero, "physical", ws=ws),
        "fuel_hospitals": lambda: nearest_edges(stations, hospital, "fuel_supplies", 10, F.lit(FUEL_TO["hospital"]), "physical", ws=ws),
        "fuel_telecom": lambda: nearest_edges(stations, served, "fuel_supplies", 11, F.lit(FUEL_TO["telecom"]), "physical", ws=ws),
        "fuel_water": lambda: nearest_edges(stations, local(water), "fuel_supplies", 12, F.lit(FUEL_TO["water"]), "physical", ws=ws),
    }


def all_edges(nodes: DataFrame, lines: DataFrame, ws=None) -> DataFrame:
    """Every producer's edges in order (rank, at), ends closed over the nodes, each (u, v) once.

    A repeated edge keeps its first place and takes the later write's attributes. Flows between water works are
    as many as their pairs; those that nothing else can write again are neither sorted nor sent to be grouped.
    """
    ws = ws or Workspace(nodes.sparkSession)
    made = edge_producers(nodes, lines, ws)
    rest = ws.save(closed_edges(union_all([make() for name, make in made.items() if name != "water_flow"]), nodes))
    water = ws.save(waters(nodes.where("node_id is not null")))
    pump, plant = F.col("subtype").isin(PUMPS), F.col("subtype").isin(PLANTS)
    # a work that is there twice, or that is an end of another edge between works, may have an edge twice
    both = rest.join(water.where(pump).select(F.col("node_id").alias("u")).distinct(), "u", "left_semi").join(water.where(plant).select(F.col("node_id").alias("v")).distinct(), "v", "left_semi")
    twice = water.where(pump | plant).groupBy("node_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("node_id")
    shared = ws.save(twice.unionByName(both.select(F.explode(F.array("u", "v")).alias("node_id"))).distinct().withColumn("_shared", F.lit(True)))
    marked = ws.save(water.join(shared, "node_id", "left").withColumn("_shared", F.coalesce("_shared", F.lit(False))))
    alone, repeated = marked.where("not _shared"), marked.where("_shared")
    flows = water_flow(alone, ws=ws)
    if not repeated.isEmpty():
        again = water_flow(repeated.where(pump), marked.where(plant), ws).unionByName(water_flow(alone.where(pump), repeated.where(plant), ws))
        rest = rest.unionByName(again.where("u <> v"), allowMissingColumns=True)
    single = flows.where("u <> v").withColumn("first_ord", F.struct("rank", "at")).drop("rank", "at")
    return last_write_wins(rest, ["rank", "at"]).unionByName(single, allowMissingColumns=True)
