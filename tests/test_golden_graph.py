"""Rebuild the edges of a known graph from its nodes.

GRIDWEAVE_GOLDEN is a JSON object of paths: graph (a GraphML document), lines, substations,
hospitals, water, plants, stations and terminals (GeoJSON). Without it the test is skipped,
since data isn't kept with the code.
"""

import json
import os

import pytest
from pyspark.sql import functions as F

from gridweave.plans import edges as E
from gridweave.plans import nodes as N
from gridweave.plans import tensors
from gridweave.operators import graph
from gridweave.sources import files
from gridweave.workspace import Workspace

PATHS = json.loads(os.environ.get("GRIDWEAVE_GOLDEN", "{}"))
pytestmark = pytest.mark.skipif(not PATHS, reason="GRIDWEAVE_GOLDEN is not set")

EDGE_COUNTS = {"power_line": 18, "subway_line": 152, "power_dependency": 319, "water_flow": 9, "water_supplies": 8, "scada_monitoring": 9, "repair_access": 247, "fuel_distribution": 13, "fuel_supplies": 156}
KIND_COUNTS = {"telecom": 224, "subway": 75, "fuel": 19, "power": 14, "hospital": 8, "water": 7}


@pytest.fixture(scope="module")
def golden(spark):
    ws = Workspace(spark)
    path = PATHS["graph"]
    nodes, want = ws.save(files.graphml_nodes(spark, path)), ws.save(files.graphml_edges(spark, path))
    lines = files.geojson(spark, PATHS["lines"], "SUB_1 string, SUB_2 string, VOLT_CLASS string, TYPE string")
    got = ws.save(E.all_edges(nodes, lines, ws))
    return nodes, want, got


def test_counts(golden):
    nodes, want, got = golden
    assert {r.infra_type: r["count"] for r in nodes.groupBy("infra_type").count().collect()} == KIND_COUNTS
    assert {r.edge_type: r["count"] for r in got.groupBy("edge_type").count().collect()} == EDGE_COUNTS


def test_every_edge_and_attribute(golden):
    _, want, got = golden
    cols = ["u", "v", "edge_type", "weight", "distance_m", "buffer_hours", "dependency_class", "line", "layer", "volt_class"]
    a = {tuple(r) for r in got.select(*cols).collect()}
    b = {tuple(r) for r in want.select(*cols).collect()}
    assert len(a) == 931 and a == b


def test_components(golden, spark):
    nodes, _, got = golden
    assert graph.weak_components(got, nodes).select("component").distinct().count() == 1
    strong = graph.strong_components(got, nodes).groupBy("component").count()
    assert strong.count() == 251 and strong.agg(F.max("count")).first()[0] == 73
    top = [r.node_id for r in graph.top_degrees(got, nodes, 2, order="ord").collect()]
    assert top == ["power_leonard_street", "power_west_19th_street"]


def test_node_producers(golden, spark):
    nodes, _, _ = golden
    ids = lambda df: {r.node_id for r in df.select("node_id").collect()}
    sub = files.geojson(spark, PATHS["substations"])
    assert ids(N.power_nodes(sub)) == ids(nodes.where("infra_type = 'power' and not external"))
    hospitals = files.geojson(spark, PATHS["hospitals"])
    assert ids(N.hospital_nodes(hospitals)) == ids(nodes.where("infra_type = 'hospital'"))
    water = [files.geojson(spark, PATHS[f]) for f in ("water", "plants")]
    assert ids(N.water_nodes(*water, ["STEPHEN A SCHWARZMAN BLDG-NYPL"])) == ids(nodes.where("infra_type = 'water'"))
    fuel = ids(N.station_nodes(files.geojson(spark, PATHS["stations"]))) | ids(N.terminal_nodes(files.geojson(spark, PATHS["terminals"])))
    assert fuel == ids(nodes.where("infra_type = 'fuel'"))


def test_tensors(golden):
    nodes, _, got = golden
    vectors = tensors.node_vectors(nodes, got)
    assert vectors.count() == 347
    edges = tensors.edge_vectors(got, vectors)
    assert edges.count() == 931 and edges.select("triplet").distinct().count() == 19
