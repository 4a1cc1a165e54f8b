"""Node and edge producers of the network applied to the driver's tables, each with SQL that says the same.

Suppliers stand for substations; customers for telecom, hospital, subway, water and fuel nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions import geo, text
from gridweave.operators import graph, tiles
from gridweave.operators.tables import union_all
from gridweave.plans import edges as E
from gridweave.plans import nodes as N
from gridweave.queries import KIND_OF, _case, _utm_sql, place, query, table
from gridweave.functions import crs
from gridweave.sources import files, rasters, services, sinks
from gridweave.workspace import Workspace

FAR = 10_000_000_000
#: Attributes of an edge that results show, with their types.
SHOWN = {"u": "string", "v": "string", "edge_type": "string", "weight": "double", "distance_m": "long", "buffer_hours": "double", "dependency_class": "string", "layer": "string", "line": "string", "volt_class": "string"}
#: Those in SQL; an absent distance is shown as -1.
COLUMNS = ", ".join("coalesce(distance_m, -1) AS distance_m" if c == "distance_m" else c for c in SHOWN)


def network_nodes(spark, d) -> DataFrame:
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    s = table(spark, d, "supplier").withColumns(place("s_suppkey", 6151, 3571))
    s = s.select(F.concat(F.lit("power_"), text.slug("s_name")).alias("node_id"), F.lit("power").alias("infra_type"), F.lit("SUBSTATION").alias("subtype"), "lat", "lon", (k % 10 == 0).alias("external"), k.alias("ord"))
    kind = text.recode("c_mktsegment", KIND_OF)
    works = F.when(c % 3 == 0, "PUMPING STATION").when(c % 3 == 1, "WASTEWATER TREATMENT PLANT").otherwise("RESERVOIR")
    fuel = F.when(c % 4 == 0, "PETROLEUM_TERMINAL").otherwise("GAS_STATION")
    t = table(spark, d, "customer").withColumns(place("c_custkey", 7919, 104729)).withColumn("infra_type", kind)
    own = lambda k, x: F.when(F.col("infra_type") == k, x)
    t = t.select(
        F.concat(F.lit("c"), c).alias("node_id"), "infra_type", F.coalesce(own("water", works), own("fuel", fuel), F.lit("NODE")).alias("subtype"), "lat", "lon", (c % 7 == 0).alias("external"), (c + FAR).alias("ord"),
        own("telecom", c % 9).alias("tower_count"), own("subway", F.format_string("L%d X%d", c % 5, c % 3)).alias("routes"),
    )
    return union_all([s, t])


def network_lines(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    volts = F.element_at(F.array(*[F.lit(v) for v in ("345", "100-161", "NOT AVAILABLE", "999")]), (k % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select(k.alias("ord"), F.col("s_name").alias("SUB_1"), F.format_string("Supplier#%09d", k * 7 % 53 + 1).alias("SUB_2"), volts.alias("VOLT_CLASS"), F.lit("AC").alias("TYPE"))


def shown(df: DataFrame) -> DataFrame:
    out = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in SHOWN.items()])
    return out.withColumn("distance_m", F.coalesce("distance_m", F.lit(-1).cast("long")))


def produced(spark, d, name: str) -> DataFrame:
    return shown(E.edge_producers(network_nodes(spark, d), network_lines(spark, d))[name]())


NET = f"""base AS (SELECT 'power_' || lower(s_name) AS node_id, 'power' AS infra_type, 'SUBSTATION' AS subtype, 40.7e0 + (s_suppkey * 6151 % 5501) / 100000.0e0 AS lat,
 -74.02e0 + (s_suppkey * 3571 % 5003) / 100000.0e0 AS lon, s_suppkey % 10 = 0 AS external, s_suppkey AS ord, NULL AS tower_count, NULL AS routes FROM supplier UNION ALL
 SELECT 'c' || c_custkey, kind, CASE WHEN kind = 'water' THEN CASE c_custkey % 3 WHEN 0 THEN 'PUMPING STATION' WHEN 1 THEN 'WASTEWATER TREATMENT PLANT' ELSE 'RESERVOIR' END
 WHEN kind = 'fuel' THEN CASE WHEN c_custkey % 4 = 0 THEN 'PETROLEUM_TERMINAL' ELSE 'GAS_STATION' END ELSE 'NODE' END, 40.7e0 + (c_custkey * 7919 % 5501) / 100000.0e0,
 -74.02e0 + (c_custkey * 104729 % 5003) / 100000.0e0, c_custkey % 7 = 0, c_custkey + {FAR}, CASE WHEN kind = 'telecom' THEN c_custkey % 9 END,
 CASE WHEN kind = 'subway' THEN printf('L%d X%d', c_custkey % 5, c_custkey % 3) END FROM (SELECT *, {_case("c_mktsegment", KIND_OF)} AS kind FROM customer)),
{_utm_sql("lat", "lon")}"""
_LINES = """ln AS (SELECT s_suppkey AS ord, 'power_' || lower(s_name) AS a, 'power_supplier#' || lpad(CAST(s_suppkey * 7 % 53 + 1 AS VARCHAR), 9, '0') AS b, ['345', '100-161', 'NOT AVAILABLE', '999'][s_suppkey % 4 + 1] AS volt FROM supplier),
way AS (SELECT a AS u, b AS v, volt, ord, 0 AS w FROM ln UNION ALL SELECT b, a, volt, ord, 1 FROM ln)"""
_SUBWAY = """st AS (SELECT node_id, ord, lat, lon, x, y, unnest(string_split(routes, ' ')) AS line, unnest(range(len(string_split(routes, ' ')))) AS route FROM placed WHERE infra_type = 'subway'),
wide AS (SELECT *, CASE WHEN max(lon) OVER p - min(lon) OVER p > max(lat) OVER p - min(lat) OVER p THEN lon ELSE lat END AS k FROM st WINDOW p AS (PARTITION BY line)),
pr AS (SELECT line, node_id AS u, lead(node_id) OVER o AS v, row_number() OVER o AS step, sqrt((lead(x) OVER o - x) * (lead(x) OVER o - x) + (lead(y) OVER o - y) * (lead(y) OVER o - y)) AS d FROM wide WINDOW o AS (PARTITION BY line ORDER BY k, ord)),
fst AS (SELECT line, min([ord, route]) AS f FROM st GROUP BY line),
hop AS (SELECT line, u, v, d, step, 0 AS w FROM pr WHERE v IS NOT NULL UNION ALL SELECT line, v, u, d, step, 1 FROM pr WHERE v IS NOT NULL)"""


def near_sql(sources: str, targets: str, kind: str, rank: int, buffer: str, dependency: str, layer: str = "NULL") -> str:
    return f"""SELECT u, v, '{kind}' AS edge_type, round(1.0e0 / (1.0e0 + d / 1000.0e0), 3) AS weight, CAST(round_even(d, 0) AS BIGINT) AS distance_m, {buffer} AS buffer_hours, '{dependency}' AS dependency_class,
CAST({layer} AS VARCHAR) AS layer, CAST(NULL AS VARCHAR) AS line, CAST(NULL AS VARCHAR) AS volt_class, CAST(NULL AS VARCHAR) AS line_type, {rank} AS rank, [t_ord, 0, 0] AS pos FROM
(SELECT *, row_number() OVER (PARTITION BY v ORDER BY d, s_ord) AS k FROM (SELECT s.node_id AS u, t.node_id AS v, t.infra_type AS kind, s.ord AS s_ord, t.ord AS t_ord, sqrt((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y)) AS d
FROM (SELECT * FROM placed WHERE {sources}) s, (SELECT * FROM placed WHERE {targets}) t)) WHERE k = 1 AND u <> v"""


_POWER, _STATION, _TERMINAL = "infra_type = 'power' AND NOT external", "subtype = 'GAS_STATION'", "subtype = 'PETROLEUM_TERMINAL'"
_KIND = "CASE kind WHEN 'telecom' THEN 6.0e0 WHEN 'hospital' THEN 96.0e0 WHEN 'water' THEN 3.0e0 ELSE 0.0e0 END"
PRODUCER_SQL = {
    "power_lines": "SELECT u, v, 'power_line' AS edge_type, CASE volt WHEN '345' THEN 3.0e0 WHEN '100-161' THEN 1.5e0 ELSE 1.0e0 END AS weight, CAST(NULL AS BIGINT) AS distance_m, 0.0e0 AS buffer_hours, CAST(NULL AS VARCHAR) AS dependency_class, CAST(NULL AS VARCHAR) AS layer, CAST(NULL AS VARCHAR) AS line, volt AS volt_class, 'AC' AS line_type, 1 AS rank, [ord, w, 0] AS pos FROM way",
    "subway_lines": "SELECT u, v, 'subway_line' AS edge_type, round(d / 1000.0e0, 3) AS weight, CAST(round_even(d, 0) AS BIGINT) AS distance_m, 0.0e0 AS buffer_hours, CAST(NULL AS VARCHAR) AS dependency_class, CAST(NULL AS VARCHAR) AS layer, line, CAST(NULL AS VARCHAR) AS volt_class, CAST(NULL AS VARCHAR) AS line_type, 2 AS rank, [f[1], f[2] * 1000000 + step, w] AS pos FROM hop JOIN fst USING (line)",
    "power_dependents": near_sql(_POWER, "infra_type <> 'power' AND NOT external", "power_dependency", 3, _KIND, "physical"),
    "power_terminals": near_sql(_POWER, _TERMINAL, "power_dependency", 4, "4.0e0", "physical"),
    "water_flow": "SELECT a.node_id AS u, b.node_id AS v, 'water_flow' AS edge_type, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 1000.0e0, 3) AS weight, CAST(round_even(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 0) AS BIGINT) AS distance_m, 0.0e0 AS buffer_hours, 'physical' AS dependency_class, CAST(NULL AS VARCHAR) AS layer, CAST(NULL AS VARCHAR) AS line, CAST(NULL AS VARCHAR) AS volt_class, CAST(NULL AS VARCHAR) AS line_type, 5 AS rank, [a.ord, b.ord, 0] AS pos FROM placed a JOIN placed b ON a.subtype = 'PUMPING STATION' AND b.subtype = 'WASTEWATER TREATMENT PLANT' AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 25000000",
    "water_supplies": near_sql("infra_type = 'water'", "infra_type = 'hospital'", "water_supplies", 6, "24.0e0", "physical"),
    "scada": near_sql("infra_type = 'telecom'", _POWER, "scada_monitoring", 7, "2.0e0", "cyber"),
    "repair_access": near_sql("infra_type = 'subway'", "infra_type <> 'subway' AND NOT external", "repair_access", 8, "0.0e0", "logical", "'recovery'"),
    "fuel_distribution": near_sql(_TERMINAL, _STATION, "fuel_distribution", 9, "0.0e0", "physical"),
    "fuel_hospitals": near_sql(_STATION, "infra_type = 'hospital'", "fuel_supplies", 10, "96.0e0", "physical"),
    "fuel_telecom": near_sql(_STATION, "infra_type = 'telecom' AND tower_count >= 5", "fuel_supplies", 11, "48.0e0", "physical"),
    "fuel_water": near_sql(_STATION, "infra_type = 'water' AND NOT external", "fuel_supplies", 12, "48.0e0", "physical"),
}
_WITH = f"WITH {NET}, {_LINES}, {_SUBWAY}"


def _register(name: str) -> None:
    def run(spark, d):
        return produced(spark, d, name)

    run.__name__ = f"edges_{name}"
    run.__doc__ = f"The edges of the producer {name}."
    query(f"{_WITH} SELECT {COLUMNS} FROM ({PRODUCER_SQL[name]})")(run)


for _name in PRODUCER_SQL:
    _register(_name)

_ALL = " UNION ALL ".join(f"({s})" for s in PRODUCER_SQL.values())
_LAST = ", ".join(f"{'coalesce(' if c == 'distance_m' else ''}last({c} ORDER BY rank, pos) FILTER (WHERE {c} IS NOT NULL){', -1)' if c == 'distance_m' else ''} AS {c}" for c in list(SHOWN)[2:])


@query(f"""{_WITH}, made AS ({_ALL}), closed AS (SELECT * FROM made WHERE u <> v AND u IN (SELECT node_id FROM base) AND v IN (SELECT node_id FROM base))
SELECT u, v, {_LAST} FROM closed GROUP BY u, v""")
def graph_assembly(spark, d):
    """All producers' edges as one graph."""
    return shown(E.all_edges(network_nodes(spark, d), network_lines(spark, d)))


def facilities(spark, d, segment: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, d, "customer").where(F.col("c_mktsegment") == segment).withColumns(place("c_custkey", 7919, 104729)).withColumn("ord", c)


_NODE = "node_id, infra_type, subtype, name, lat, lon, external"


@query(f"""WITH c AS (SELECT *, 40.7e0 + (c_custkey * 7919 % 5501) / 100000.0e0 AS lat, -74.02e0 + (c_custkey * 104729 % 5003) / 100000.0e0 AS lon FROM customer),
n0 AS (SELECT 0 AS p, s_suppkey AS a, 0 AS b, 'power_' || lower(s_name) AS node_id, 'power' AS infra_type, 'SUBSTATION' AS subtype, s_name AS name, 40.7e0 + (s_suppkey * 6151 % 5501) / 100000.0e0 AS lat, -74.02e0 + (s_suppkey * 3571 % 5003) / 100000.0e0 AS lon, false AS external FROM supplier),
h AS (SELECT *, 'T' || (c_custkey % 3) AS ft, 40.7e0 + (c_custkey % 40) / 1000.0e0 AS hlat, row_number() OVER (PARTITION BY c_custkey % 40 ORDER BY 'T' || (c_custkey % 3), c_custkey) AS k FROM c WHERE c_mktsegment = 'BUILDING'),
n3 AS (SELECT 3, 0, c_custkey, 'hospital_' || lower(substr(c_name, 1, 30)), 'hospital', ft, c_name, hlat, -74.0e0, false FROM h WHERE k = 1),
n6 AS (SELECT 6, c_custkey, 0, 'fuel_station_' || CASE WHEN c_custkey % 4 = 0 THEN 'gas_station' ELSE 'fuel_stop_' || c_custkey % 2 END || printf('_%03d', c_custkey), 'fuel', 'GAS_STATION',
 CASE WHEN c_custkey % 4 = 0 THEN 'Gas Station' ELSE 'Fuel/Stop ' || c_custkey % 2 END || CASE WHEN c_custkey % 3 = 0 THEN ' (Shell)' ELSE '' END, lat, lon, NOT (lat BETWEEN {N.AREA[0]}e0 AND {N.AREA[1]}e0 AND lon BETWEEN {N.AREA[2]}e0 AND {N.AREA[3]}e0) FROM c WHERE c_mktsegment = 'MACHINERY'),
n7 AS (SELECT 7, c_custkey, 0, 'fuel_terminal_terminal_no._' || c_custkey % 50, 'fuel', 'PETROLEUM_TERMINAL', 'Terminal, No. (' || c_custkey % 50 || ')', lat, lon, true FROM c WHERE c_mktsegment = 'HOUSEHOLD'),
u AS (SELECT * FROM n0 UNION ALL SELECT * FROM n3 UNION ALL SELECT * FROM n6 UNION ALL SELECT * FROM n7),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY p, a, b) AS k FROM u) WHERE k = 1)
SELECT {_NODE}, row_number() OVER (ORDER BY p, a, b, node_id) - 1 AS ord FROM one""")
def node_producers_unified(spark, d):
    """Substations, hospitals, stations and terminals as one node table, each id once, numbered."""
    c = F.col("c_custkey")
    s = table(spark, d, "supplier").withColumns(place("s_suppkey", 6151, 3571))
    sub = s.select(F.col("s_suppkey").alias("ord"), F.upper("s_name").alias("NAME"), F.lit("SUBSTATION").alias("TYPE"), F.col("lat").alias("LATITUDE"), F.col("lon").alias("LONGITUDE"), F.lit("IN SERVICE").alias("STATUS"))
    h = facilities(spark, d, "BUILDING").select("ord", F.col("c_name").alias("FACNAME"), F.format_string("T%d", c % 3).alias("FACTYPE"), F.lit("a road").alias("ADDRESS"), (F.lit(40.7) + c % 40 / F.lit(1000.0)).alias("LATITUDE"), F.lit(-74.0).alias("LONGITUDE"))
    st = facilities(spark, d, "MACHINERY").select("ord", F.when(c % 4 != 0, F.format_string("Fuel/Stop %d", c % 2)).alias("name"), F.when(c % 3 == 0, "Shell").when(c % 3 == 1, "").alias("brand"), "lat", "lon")
    te = facilities(spark, d, "HOUSEHOLD").select("ord", F.format_string("Terminal, No. (%d)", c % 50).alias("name"), "lat", "lon", F.when(c % 2 == 0, c).alias("capacity_bbl"))
    out = N.unified([N.power_nodes(sub), N.hospital_nodes(h), N.station_nodes(st), N.terminal_nodes(te)], Workspace(spark))
    return out.select("node_id", "infra_type", "subtype", "name", "lat", "lon", "external", F.col("ord").cast("long").alias("ord"))


@query("""WITH e AS (SELECT event_id, 40.7e0 + (user_id * 31 % 550) / 10000.0e0 AS lat, -74.02e0 + (event_id * 37 % 500) / 10000.0e0 AS lon, event_type AS radio,
CASE user_id % 4 WHEN 0 THEN 'T-Mobile' WHEN 1 THEN 'AT&T' WHEN 2 THEN 'T-Mobile Metro' ELSE '310/999' END AS op FROM events),
cl AS (SELECT op, CAST(round_even(lat / 0.005e0, 0) AS BIGINT) AS a, CAST(round_even(lon / 0.005e0, 0) AS BIGINT) AS b, count(*) AS tower_count, string_agg(DISTINCT radio, ',' ORDER BY radio) AS radio_types, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon FROM e GROUP BY ALL)
SELECT printf('telecom_cluster_%04d', row_number() OVER (ORDER BY op, a, b) - 1) AS node_id, op || ' cluster' AS name, op AS operator, tower_count, radio_types, lat, lon FROM cl""")
def node_producer_telecom(spark, d):
    u = F.col("user_id")
    net = F.when(u % 4 == 0, 260).when(u % 4 == 1, 410).when(u % 4 == 2, 240).otherwise(999)
    t = table(spark, d, "events").select((F.lit(40.7) + (u * 31 % 550) / F.lit(10000.0)).alias("lat"), (F.lit(-74.02) + (F.col("event_id") * 37 % 500) / F.lit(10000.0)).alias("lon"), F.col("event_type").alias("radio"), F.lit(310).alias("mcc"), net.alias("net"))
    return N.telecom_nodes(t, Workspace(spark)).select("node_id", "name", "operator", "tower_count", "radio_types", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("""WITH c AS (SELECT c_custkey AS ord, c_custkey % 3 AS part, CASE WHEN c_custkey % 5 = 0 THEN 'Old Library' ELSE 'Works ' || c_custkey END AS name, 40.7e0 + (c_custkey * 7919 % 5501) / 100000.0e0 AS lat, -74.02e0 + (c_custkey * 104729 % 5003) / 100000.0e0 AS lon FROM customer),
base AS (SELECT *, 1 AS one FROM c), """ + _utm_sql("lat", "lon") + """,
a AS (SELECT * FROM placed WHERE part > 0 AND name <> 'Old Library'),
b AS (SELECT * FROM placed p WHERE part = 0 AND NOT EXISTS (SELECT 1 FROM a WHERE sqrt((a.x - p.x) * (a.x - p.x) + (a.y - p.y) * (a.y - p.y)) < 50))
SELECT 'water_' || replace(lower(name), ' ', '_') AS node_id, name, lat, lon, false AS external FROM a UNION ALL SELECT 'water_' || replace(lower(name), ' ', '_'), name, lat, lon, true FROM b""")
def node_producer_water(spark, d):
    c = F.col("c_custkey")
    rows = table(spark, d, "customer").withColumns(place("c_custkey", 7919, 104729))
    rows = rows.select(c.alias("ord"), (c % 3).alias("third"), F.when(c % 5 == 0, "Old Library").otherwise(F.concat(F.lit("Works "), c)).alias("name"), "lat", "lon", F.lit("PLANT").alias("type"), F.lit("city").alias("operator"))
    out = N.water_nodes(rows.where("third > 0").drop("third"), rows.where("third = 0").drop("third"), ["Old Library"], 50.0)
    return out.select("node_id", "name", "lat", "lon", "external")


@query("""WITH p AS (SELECT 'SITE ' || (p_partkey % 5000 + p_size) AS name FROM part), known AS (SELECT 'SITE ' || p_partkey AS name FROM part WHERE p_size > 20)
SELECT DISTINCT 'power_site_' || substr(name, 6) AS node_id, 'EXTERNAL' AS status, true AS external FROM p WHERE name NOT IN (SELECT name FROM known)""")
def node_producer_external_power(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    site = lambda key: F.concat(F.lit("Site "), key.cast("string"))
    lines = p.select(k.alias("ord"), site(k % 5000 + F.col("p_size")).alias("SUB_1"), F.lit(None).cast("string").alias("SUB_2"))
    local = p.where("p_size > 20").select(site(k).alias("NAME"))
    city = p.select(k.alias("ord"), site(k).alias("NAME"), F.lit(40.7).alias("LATITUDE"), F.lit(-74.0).alias("LONGITUDE"))
    return N.external_power_nodes(lines, local, city).select("node_id", "status", "external")


@query(f"""WITH {NET}, s AS (SELECT node_id, ord, unnest(string_split(routes, ' ')) AS line FROM base WHERE routes IS NOT NULL)
SELECT line, string_agg(node_id, ',' ORDER BY ord) AS stations FROM s GROUP BY line""")
def line_station_lists(spark, d):
    out = graph.stations_by_line(network_nodes(spark, d).where("routes is not null"))
    return out.select("line", F.array_join("stations", ",").alias("stations"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN true ELSE false END AS yes, CASE WHEN c_custkey % 4 = 0 THEN 'Auto Mobile' ELSE 'Power Line' END AS caption, CASE WHEN c_acctbal % 2 = 0 OR c_acctbal IS NULL THEN -1.0e0 ELSE c_acctbal END AS balance,
CASE WHEN c_custkey % 5 = 0 THEN 'external' WHEN c_custkey % 5 = 1 THEN '—' ELSE CAST(c_custkey % 5 AS VARCHAR) END AS division, greatest(8, least(50, CAST(trunc(c_custkey % 7 * 18) AS INT))) AS radius, c_acctbal <> 0 AS here, 40.7e0 + (c_custkey % 100) / 200.0e0 AS mid_lat FROM customer""")
def tolerant_parsing(spark, d):
    """Booleans, captions, fallbacks, divisions, radii, presence and midpoints."""
    c, b = F.col("c_custkey"), F.col("c_acctbal")
    yes = F.when(c % 6 == 0, " YES ").when(c % 6 == 3, "True").when(c % 6 == 1, "no")
    division = F.when(c % 5 == 0, "-1").when(c % 5 == 1, "x").otherwise((c % 5).cast("string"))
    balance = F.when(b % 2 == 0, 0.0).otherwise(b)
    rows = table(spark, d, "customer").select(c.alias("c_custkey"), b.alias("b"), yes.alias("yes"), F.when(c % 4 == 0, "auto_mobile").otherwise("power_line").alias("caption"), balance.alias("balance"), F.lit(-1.0).alias("other"), division.alias("division"), (c % 7).alias("depth"), ((c % 100) / F.lit(100.0)).alias("rise"))
    lat = geo.midpoint(F.lit(40.7), F.lit(40.7) + F.col("rise"))
    return rows.select("c_custkey", text.tolerant_bool("yes").alias("yes"), text.label("caption").alias("caption"), text.nonzero_or("balance", "other").alias("balance"), text.division_label("division").alias("division"), text.depth_radius("depth").alias("radius"), text.present("b").alias("here"), lat.alias("mid_lat"))


@query(f"""WITH {NET} SELECT node_id, infra_type, lat, lon, external, coalesce(tower_count, -1) AS tower_count FROM base""")
def graphml_round_trip(spark, d):
    """Nodes and edges written as a graph document and read again."""
    ws = Workspace(spark)
    n = network_nodes(spark, d)
    e = n.where("infra_type = 'power'").select(F.col("node_id").alias("u"), F.lit("c1").alias("v"), F.lit(1.5).alias("weight"), "ord")
    sinks.write_graphml(n.drop("routes", "subtype"), e, f"{ws.root}/graph")
    back = files.graphml_nodes(spark, f"{ws.root}/graph")
    return back.select("node_id", "infra_type", "lat", "lon", "external", F.coalesce("tower_count", F.lit(-1)).alias("tower_count"))


@query("SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, 40.7e0 + (s_suppkey * 6151 % 5501) / 100000.0e0 AS y FROM supplier")
def geojson_round_trip(spark, d):
    """A layer written as one GeoJSON document and read again."""
    ws = Workspace(spark)
    s = table(spark, d, "supplier").withColumns(place("s_suppkey", 6151, 3571))
    rows = s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), "lat", "lon")
    sinks.write_feature_collection(rows, f"{ws.root}/layer", order="key")
    return files.geojson(spark, f"{ws.root}/layer", "key long, name string, balance double").select("key", "name", "balance", "y")


@query("SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer")
def csv_round_trip(spark, d):
    """A table written as CSV without its geometry and read again by position."""
    ws = Workspace(spark)
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("POINT").alias("geometry"))
    sinks.write_csv(rows, f"{ws.root}/table")
    return files.csv(spark, f"{ws.root}/table", "key long, name string, balance double")


_PLACES = "40.7e0 + (s_suppkey * 6151 % 5501) / 100000.0e0 AS y, -74.02e0 + (s_suppkey * 3571 % 5003) / 100000.0e0 AS x"


@query(f"WITH s AS (SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, {_PLACES} FROM supplier) SELECT * FROM s WHERE x BETWEEN -74.015e0 AND -73.98e0 AND y >= 40.705e0 AND y <= 40.745e0")
def feature_service_pages(spark, d):
    """Suppliers served by pages of 50 features; the box is handed to the service."""
    ws = Workspace(spark)
    s = table(spark, d, "supplier").withColumns(place("s_suppkey", 6151, 3571))
    s = s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), "lat", "lon")
    services.save_pages(s.select("key", sinks.features_text(s).alias("value")), f"{ws.root}/pages", 50, "key", ws)
    services.register(spark)
    layer = spark.read.format("feature_service").schema("key long, name string, balance double, x double, y double").option("size", 50).load(f"{ws.root}/pages")
    return layer.where("x between -74.015 and -73.98 and y >= 40.705 and y <= 40.745")


@query("""WITH c AS (SELECT c_custkey AS key, c_name AS name, -74.02e0 + (c_custkey * 104729 % 5003) / 100000.0e0 AS lon FROM customer)
SELECT key, name, round(lon, 6) AS lon, CASE WHEN lon < -73.99e0 THEN 0 ELSE 1 END AS first_tile FROM c""")
def tiled_boxes(spark, d):
    """Customers in answers of two overlapping boxes, each once."""
    ws = Workspace(spark)
    c = table(spark, d, "customer").withColumns(place("c_custkey", 7919, 104729)).select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "lon")
    tiles = c.withColumn("tile", F.explode(F.array_compact(F.array(F.when(F.col("lon") < -73.99, 0), F.when(F.col("lon") > -74.0, 1)))))
    tiles.withColumn("first_tile", F.col("tile")).write.partitionBy("tile").option("header", True).csv(f"{ws.root}/tiles")
    services.register(spark)
    rows = spark.read.format("tiled_csv").schema("tile int, line long, key long, name string, lon double, first_tile int").option("least", 0).load(f"{ws.root}/tiles")
    return services.first_of_tiles(rows, ["key"]).withColumn("lon", F.round("lon", 6))


@query("SELECT 's' || l_suppkey AS u, 'o' || l_orderkey AS v, l_quantity / 4 AS weight, l_linenumber AS line FROM lineitem")
def graph_document_edges(spark, d):
    """Line items as edges of a graph document, parallel ones too, written by many tasks and read again."""
    ws, k = Workspace(spark), F.col("l_orderkey")
    e = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("u"), F.concat(F.lit("o"), k).alias("v"), (F.col("l_quantity") / 4).alias("weight"), F.col("l_linenumber").alias("line"), (k * 10 + F.col("l_linenumber")).alias("ord"))
    n = e.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    sinks.write_graphml(n, e, f"{ws.root}/graph")
    return files.graphml_edges(spark, f"{ws.root}/graph").select("u", "v", "weight", F.col("line").cast("int").alias("line"))


@query("""WITH e AS (SELECT event_type AS radio, 310 AS mcc, CAST(user_id AS BIGINT) AS net, CAST(event_id AS BIGINT) AS cell, round(40.7e0 + (user_id * 31 % 550) / 10000.0e0, 6) AS lat FROM events) SELECT * FROM e""")
def gzip_towers(spark, d):
    """Events as a gzipped export of cell towers, whose header is replaced."""
    ws = Workspace(spark)
    own = {"radio": F.col("event_type"), "mcc": F.lit(310), "net": F.col("user_id"), "cell": F.col("event_id"), "lat": F.lit(40.7) + (F.col("user_id") * 31 % 550) / F.lit(10000.0)}
    names = [c.split()[0] for c in files.TOWER_COLUMNS.split(", ")]
    rows = table(spark, d, "events").select(*[own.get(c, F.lit(1)).alias(f"any_{i}") for i, c in enumerate(names)])
    rows.write.option("header", True).option("compression", "gzip").csv(f"{ws.root}/towers")
    return files.towers(spark, f"{ws.root}/towers").select("radio", "mcc", F.col("net").cast("long").alias("net"), "cell", F.round("lat", 6).alias("lat"))


@query("""SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INT) AS division, 980000.0e0 + s_suppkey * 100 AS left, 195000.0e0 - s_suppkey * 10 - (s_suppkey % 7 + 1) * 20 AS bottom,
 980000.0e0 + s_suppkey * 100 + (s_suppkey % 5 + 1) * 30 AS right, 195000.0e0 - s_suppkey * 10 AS top FROM supplier""")
def raster_tile_bounds(spark, d):
    """A GeoTIFF tile for each supplier, without pixels; bounds from its tags, numbered by name."""

    def tiles(batches):
        import struct

        import pandas as pd

        for pdf in batches:
            content = []
            for k in pdf["s_suppkey"].tolist():
                head = struct.pack("<2sHIH", b"II", 42, 8, 4) + struct.pack("<HHIHH", 256, 3, 1, k % 5 + 1, 0) + struct.pack("<HHIHH", 257, 3, 1, k % 7 + 1, 0)
                head += struct.pack("<HHII", 33550, 12, 3, 62) + struct.pack("<HHII", 33922, 12, 6, 86) + struct.pack("<I", 0)
                content.append(head + struct.pack("<3d", 30.0, 20.0, 0.0) + struct.pack("<6d", 0, 0, 0, 980000.0 + k * 100, 195000.0 - k * 10, 0))
            yield pd.DataFrame({"path": [f"tile_{k:012d}.tif" for k in pdf["s_suppkey"]], "content": content})

    made = table(spark, d, "supplier").select("s_suppkey").mapInPandas(tiles, "path string, content binary")
    return rasters.numbered_bounds(made)


def _lambert_sql(lat: str, lon: str) -> str:
    """x and y in feet of columns in degrees, as SQL: the conformal cone of two parallels."""
    n, scaled, rho0 = geo._lcc_constants()
    e = repr(geo.ECCENTRICITY) + "e0"
    t = f"tan(pi() / 4 - radians({lat}) / 2) / pow((1 - {e} * sin(radians({lat}))) / (1 + {e} * sin(radians({lat}))), {e} / 2)"
    rho, theta = f"({scaled!r}e0 * pow({t}, {n!r}e0))", f"(radians({lon} + 74.0e0) * {n!r}e0)"
    return f"({rho} * sin({theta}) + 300000.0e0) * 3937 / 1200 AS x, ({rho0!r}e0 - {rho} * cos({theta})) * 3937 / 1200 AS y"


@query(f"""WITH s AS (SELECT s_suppkey AS key, 40.7e0 + (s_suppkey * 6151 % 5501) / 100000.0e0 AS lat, -74.02e0 + (s_suppkey * 3571 % 5003) / 100000.0e0 AS lon FROM supplier), f AS (SELECT key, lat, lon, {_lambert_sql("lat", "lon")} FROM s)
SELECT key, round(x, 3) AS x, round(y, 3) AS y, round(lat, 5) AS lat, round(lon, 5) AS lon FROM f""")
def reference_systems(spark, d):
    """Suppliers in degrees, UTM metres and state-plane feet by the tags of their columns, and back in degrees."""
    s = table(spark, d, "supplier").withColumns(place("s_suppkey", 6151, 3571)).select(F.col("s_suppkey").alias("key"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    degrees = crs.tagged(s, "x", "y", 4326)
    feet = crs.transformed(degrees, "x", "y", 2263)
    back = crs.transformed(crs.transformed(feet, "x", "y", 32618), "x", "y", 4326).select("key", F.round("y", 5).alias("lat"), F.round("x", 5).alias("lon"))
    return feet.join(back, "key").select("key", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "lat", "lon")


@query(f"""WITH {NET}, n AS (SELECT 'nodes' AS part, infra_type AS name, count(*) AS rows, 2 AS width FROM base GROUP BY infra_type), e AS (SELECT 'edges' AS part, 'power__supplies__' || infra_type AS name, count(*) AS rows, 1 AS width FROM base WHERE infra_type <> 'power' GROUP BY infra_type)
SELECT * FROM n UNION ALL SELECT * FROM e""")
def tensor_bundle(spark, d):
    """Vectors saved with digests taken while they are written, read back and compared; rows and widths of each part."""
    ws = Workspace(spark)
    n = network_nodes(spark, d)
    vectors = n.select("infra_type", "ord", F.array("lat", "lon").alias("features"))
    edges = n.where("infra_type <> 'power'").select(F.lit("power").alias("src_type"), F.lit("supplies").alias("relation"), F.col("infra_type").alias("dst_type"), "ord", F.array("lat").alias("attr"))
    sinks.write_tensors(vectors, edges, f"{ws.root}/bundle")
    return sinks.tensor_summary(spark, f"{ws.root}/bundle", ["features"], ["attr"])


def _mercator_sql(lat: str, lon: str, zoom: str) -> str:
    """u and v of columns in units of a zoom, as SQL."""
    return f"CAST(round(({lon} + 180) / 360 * pow(2, {zoom}) * 4096) AS BIGINT), CAST(round((0.5e0 - ln(tan(pi() / 4 + radians({lat}) / 2)) / (2 * pi())) * pow(2, {zoom}) * 4096) AS BIGINT)"


@query(f"""WITH {NET}, z AS (SELECT unnest([11, 13, 15]) AS zoom), p AS (SELECT zoom, infra_type, CAST(floor((lon + 180) / 360 * pow(2, zoom)) AS INT) AS tx,
CAST(floor((0.5e0 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi())) * pow(2, zoom)) AS INT) AS ty FROM base, z) SELECT zoom, tx, ty, infra_type, count(*) AS n FROM p GROUP BY ALL""")
def node_tiles(spark, d):
    """Nodes by map tile and zoom: how many of each kind a tile draws."""
    n = network_nodes(spark, d)
    placed = tiles.point_tiles(n.withColumn("key", F.struct("infra_type", "node_id")), "key", [11, 13, 15])
    return placed.groupBy("zoom", "tx", "ty", F.col("key.infra_type").alias("infra_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH c AS (SELECT c_custkey AS key, 40.7e0 + (c_custkey * 7919 % 5501) / 100000.0e0 AS lat, -74.02e0 + (c_custkey * 104729 % 5003) / 100000.0e0 AS lon, 40.7e0 + (c_custkey * 6151 % 5501) / 100000.0e0 AS lat2, -74.02e0 + (c_custkey * 3571 % 5003) / 100000.0e0 AS lon2 FROM customer),
z AS (SELECT unnest([10, 14]) AS zoom), p AS (SELECT key, zoom, [{_mercator_sql("lat", "lon", "zoom")}] AS a, [{_mercator_sql("lat2", "lon2", "zoom")}] AS b FROM c, z),
s AS (SELECT key, zoom, a[1] AS u1, a[2] AS v1, b[1] AS u2, b[2] AS v2 FROM p WHERE a <> b),
x AS (SELECT *, unnest(generate_series(least(u1, u2) // 4096, greatest(u1, u2) // 4096)) AS tx FROM s),
y AS (SELECT *, CASE WHEN u1 = u2 THEN v1 ELSE v1 + (greatest(least(u1, u2), tx * 4096) - u1) * (v2 - v1) / CAST(u2 - u1 AS DOUBLE) END AS q, CASE WHEN u1 = u2 THEN v2 ELSE v1 + (least(greatest(u1, u2), (tx + 1) * 4096) - u1) * (v2 - v1) / CAST(u2 - u1 AS DOUBLE) END AS r FROM x),
t AS (SELECT key, zoom, tx, unnest(generate_series(CAST(floor(least(q, r) / 4096) AS BIGINT), CAST(floor(greatest(q, r) / 4096) AS BIGINT))) AS ty FROM y)
SELECT zoom, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, count(*) AS n, count(DISTINCT key) AS lines FROM t GROUP BY ALL""")
def line_tiles(spark, d):
    """Lines from each customer's place to another, cut to map tiles: how many pieces a tile draws."""
    c = table(spark, d, "customer").withColumns(place("c_custkey", 7919, 104729)).withColumnsRenamed({"lat": "lat1", "lon": "lon1"}).withColumns(place("c_custkey", 6151, 3571))
    lines = c.select("c_custkey", F.array(F.array("lon1", "lat1"), F.array("lon", "lat")).alias("coordinates"))
    return tiles.line_tiles(lines, "c_custkey", [10, 14]).groupBy("zoom", "tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("lines"))
