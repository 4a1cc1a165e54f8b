"""Feature vectors of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.text import recode, safe_double, token_count, tolerant_bool
from gridweave.functions.weights import coupling
from gridweave.operators.ordering import if_few

# Defaults of the eight features by kind, kilovolts by voltage class, relation names.
DEFAULTS = {"lat": 40.72, "lon": -73.99, "elevation": 3.0, "flood_depth": 0.0}
MAX_VOLT_DEFAULT, TERMINAL_BARRELS, STATION_BARRELS = 138.0, 1_000_000.0, 10_000.0
KILOVOLTS = {"345": 345.0, "220-287": 230.0, "100-161": 138.0, "UNDER 100": 69.0, "NOT AVAILABLE": 138.0}
RELATIONS = {"power_dependency": "feeds", "water_supplies": "supplies", "scada_monitoring": "scada_monitors"}
KINDS = ("power", "telecom", "hospital", "subway", "water", "fuel")


def flag(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


def common() -> list[Column]:
    place = [safe_double(c, DEFAULTS[c]) for c in ("lat", "lon")]
    return [*place, F.lit(DEFAULTS["elevation"]), F.lit(DEFAULTS["flood_depth"])]


def own_features(kind: str) -> list[Column]:
    """Features five to eight of a kind of node."""
    up = F.upper(F.coalesce(F.col("subtype"), F.lit("")))
    external = flag(tolerant_bool("external"))
    radio = F.coalesce(F.col("radio_types"), F.lit(""))
    terminal = up.contains("TERMINAL")
    return {
        "power": lambda: [flag(F.col("status") == "IN SERVICE"), safe_double("max_volt", MAX_VOLT_DEFAULT), safe_double("degree_centrality", 0.0), external],
        "telecom": lambda: [safe_double("tower_count", 1.0), flag(radio.contains("LTE")), flag(radio.contains("NR") | radio.contains("5G")), F.lit(6.0)],
        "hospital": lambda: [F.lit(200.0), F.lit(96.0), F.lit(1.0), F.lit(1.0)],
        "subway": lambda: [token_count("routes").cast("double"), flag(safe_double("ada", 0.0) >= 1), F.lit(15.0), F.lit(0.0)],
        "water": lambda: [flag(up.contains("TREATMENT") | up.contains("CONTROL")), flag(up.contains("PUMP")), F.lit(50.0), external],
        "fuel": lambda: [flag(terminal), F.when(terminal, safe_double("capacity_bbl", TERMINAL_BARRELS)).otherwise(F.lit(STATION_BARRELS)), flag(terminal), external],
    }[kind]()


def node_features(nodes: DataFrame, kind: str = "infra_type") -> DataFrame:
    """Add ``features``, eight floats; kinds that aren't known go. Absent columns count as null."""
    for c in ("subtype", "external", "radio_types", "status", "max_volt", "degree_centrality", "tower_count", "routes", "ada", "capacity_bbl"):
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast("string"))
    vector = F.lit(None).cast("array<float>")
    for k in KINDS:
        vector = F.when(F.col(kind) == k, F.array(*common(), *own_features(k)).cast("array<float>")).otherwise(vector)
    return nodes.where(F.col(kind).isin(*KINDS)).withColumn("features", vector)


def scaled_vectors(df: DataFrame, by: str, column: str = "features", width: int = 8) -> DataFrame:
    """Vectors scaled to 0..1 by position within each key; the raw one is kept as ``raw_features``."""
    ends = df.groupBy(by).agg(*[f(F.get(column, i)).alias(f"_{k}{i}") for i in range(width) for k, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(if_few(ends), by)
    scale = lambda i: (F.get(F.col(column), i) - F.col(f"_lo{i}")) / F.when(F.col(f"_hi{i}") == F.col(f"_lo{i}"), F.lit(1.0)).otherwise(F.col(f"_hi{i}") - F.col(f"_lo{i}"))
    return out.withColumn(f"raw_{column}", F.col(column)).withColumn(column, F.array(*[scale(i) for i in range(width)]).cast("array<float>")).drop(*[f"_{k}{i}" for i in range(width) for k in ("lo", "hi")])


def edge_features() -> Column:
    """weight, distance, buffer hours and coupling as floats."""
    return F.array(F.coalesce("weight", F.lit(1.0)), F.coalesce(F.col("distance_m").cast("double"), F.lit(0.0)), F.coalesce("buffer_hours", F.lit(0.0)), coupling("buffer_hours")).cast("array<float>")


def relation(edge_type="edge_type") -> Column:
    return F.coalesce(recode(edge_type, RELATIONS), F.col(edge_type) if isinstance(edge_type, str) else edge_type)


def edge_index(edges: DataFrame, indexed: DataFrame, node_id: str = "node_id", kind: str = "infra_type") -> DataFrame:
    """(src_type, relation, dst_type, src_idx, dst_idx, edge_attr); edges of unknown nodes go."""
    own = lambda end: indexed.select(F.col(node_id).alias(end), F.col(kind).alias(f"{end}_type"), F.col("idx").alias(f"{end}_idx"))
    e = edges.join(own("u"), "u").join(own("v"), "v")
    return e.select(F.col("u_type").alias("src_type"), relation().alias("relation"), F.col("v_type").alias("dst_type"), F.col("u_idx").alias("src_idx"), F.col("v_idx").alias("dst_idx"), edge_features().alias("edge_attr"))
