"""Graph tables as index-encoded, scaled vectors for graph learning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.text import recode
from gridweave.operators.features import KILOVOLTS, edge_index, node_features, scaled_vectors
from gridweave.operators.graph import degree_centrality, largest_at_ends, local_index


def node_vectors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, infra_type, idx, features, raw_features) of all known kinds."""
    central = degree_centrality(edges, nodes)
    volt = largest_at_ends(edges, recode("volt_class", KILOVOLTS), "max_volt")
    rich = nodes.join(central, "node_id", "left").join(volt, "node_id", "left")
    return scaled_vectors(local_index(node_features(rich)), "infra_type").select("node_id", "infra_type", "idx", "features", "raw_features")


def edge_vectors(edges: DataFrame, indexed: DataFrame) -> DataFrame:
    """Edges as indices of their ends' kinds, with raw and scaled attributes by triplet."""
    triplet = F.concat_ws("|", "src_type", "relation", "dst_type")
    return scaled_vectors(edge_index(edges, indexed).withColumn("triplet", triplet), "triplet", "edge_attr", 4)


def schema_summary(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(part, name, n): rows by kind and by triplet."""
    n = node_rows.groupBy(F.col("infra_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("nodes"))
    e = edge_rows.groupBy(F.col("triplet").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("edges"))
    return n.unionByName(e)
