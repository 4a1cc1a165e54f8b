"""The network's vectors and components, on nodes and edges of the smallest tables."""

from pyspark.sql import functions as F

from gridweave import network_queries as q
from gridweave.operators import graph
from gridweave.plans import edges as E
from gridweave.plans import tensors
from gridweave.workspace import Workspace

FOLDER = "/root/testdata/sf0.001"


def test_vectors_and_components_of_the_assembled_graph(spark):
    ws = Workspace(spark)
    nodes = ws.save(q.network_nodes(spark, FOLDER).withColumn("name", F.col("node_id")))
    edges = ws.save(E.all_edges(nodes, q.network_lines(spark, FOLDER), ws))
    vectors = ws.save(tensors.node_vectors(nodes, edges))
    assert vectors.count() == nodes.count() and vectors.where("size(features) = 8").count() == nodes.count()
    last = vectors.groupBy("infra_type").agg(F.max("idx").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.m == r.n - 1 for r in last)
    out = tensors.edge_vectors(edges, vectors)
    assert out.count() == edges.count() and out.where("size(edge_attr) = 4").count() == edges.count()
    weak = graph.weak_components(edges, nodes)
    assert weak.count() == nodes.count() and 1 <= weak.select("component").distinct().count() < nodes.count()
    ws.clear()


def test_nearest_of_far_and_repeated_targets(spark):
    from gridweave.operators import joins

    s = spark.createDataFrame([(i, float(i % 7), float(i // 7)) for i in range(49)], "s int, x double, y double")
    t = spark.createDataFrame([(1, 3.2, 3.1), (2, 5000.0, -9000.0), (3, None, 1.0), (4, 0.1, 0.1), (4, 6.0, 6.0), (5, 2.5, 2.0)], "t int, x double, y double")
    for most in (0, 100):
        got = {r.t: (r.s, round(r.metres, 6)) for r in joins.nearest(t, s, "t", "s", broadcast_rows=most).collect()}
        assert got[1][0] == 24 and got[2][0] == 6 and got[4] == (48, 0.0) and got[5] == (16, 0.5) and 3 not in got
    assert joins.nearest(t, s.limit(0), "t", "s").count() == 0 == joins.nearest(t.limit(0), s, "t", "s").count()


def test_boxes_of_all_sizes_meet_by_cells(spark, monkeypatch):
    from gridweave.operators import joins

    boxes = [(i, float(i), float(i), i + 0.5 * 4**k, i + 0.3 * 3**k) for i in range(12) for k in [i % 6]] + [(99, -1e6, -1e6, 1e6, 1e6)]
    b = spark.createDataFrame(boxes, "division int, left double, bottom double, right double, top double")
    points = [(i, i * 0.77, i * 0.6) for i in range(60)]
    p = spark.createDataFrame(points, "k int, x double, y double")
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    got = {r.k: r.division for r in joins.first_box(p, b, "k").collect()}
    assert got == {k: min([i for i, l, o, r, t in boxes if l <= x <= r and o <= y <= t], default=-1) for k, x, y in points}


def test_strong_components_of_a_long_cycle_in_few_rounds(spark, monkeypatch):
    """A chain of 10,000 edges that closes, and one that doesn't: shortcuts take rounds by the logarithm."""
    from gridweave.operators import graph

    rounds, step = [], graph._step
    monkeypatch.setattr(graph, "_step", lambda *a: rounds.append(1) or step(*a))
    n = 10_001
    chain = spark.range(n - 1).selectExpr("id AS u", "id + 1 AS v")
    nodes = spark.range(n).withColumnRenamed("id", "node_id")
    closed = chain.unionByName(spark.createDataFrame([(n - 1, 0)], "u long, v long"))
    assert {r.component for r in graph.strong_components(closed, nodes).collect()} == {0}
    assert len(rounds) < 40


def test_strong_components_equal_plain_reachability(spark):
    import random

    from gridweave.operators import graph

    r = random.Random(3)
    n = 60
    edges = {(r.randrange(n), r.randrange(n)) for _ in range(75)}
    reach = {i: {i} for i in range(n)}
    for _ in range(n):
        for u, v in edges:
            reach[u] |= reach[v]
    want = {i: min(j for j in range(n) if j in reach[i] and i in reach[j]) for i in range(n)}
    e = spark.createDataFrame([*edges, (None, 3), (4, None)], "u long, v long")
    found = graph.strong_components(e, spark.range(n).withColumnRenamed("id", "node_id"))
    assert {x.node_id: x.component for x in found.collect()} == want


def test_flows_that_nothing_writes_again_are_not_grouped(spark, monkeypatch):
    """Of two pumps and two plants, one pump is there twice and so only its flows are taken together."""
    rows = [("p1", 1, "PUMPING STATION", 40.70), ("p1", 2, "PUMPING STATION", 40.71), ("p2", 3, "PUMPING STATION", 40.72), ("w1", 4, "WASTEWATER TREATMENT PLANT", 40.70), ("w2", 5, "WASTEWATER TREATMENT PLANT", 40.71)]
    nodes = spark.createDataFrame([(n, "water", k, lat, -74.0, False, o, 0, "") for n, o, k, lat in rows], "node_id string, infra_type string, subtype string, lat double, lon double, external boolean, ord long, tower_count long, routes string")
    lines = spark.createDataFrame([], "SUB_1 string, SUB_2 string, VOLT_CLASS string, TYPE string, ord long")
    seen, last = [], E.last_write_wins

    def watched(df, order):
        seen.append(df.where("edge_type = 'water_flow'").count())
        return last(df, order)

    monkeypatch.setattr(E, "last_write_wins", watched)
    out = {(r.u, r.v): (r.distance_m, list(r.first_ord.at)) for r in E.all_edges(nodes, lines).collect()}
    assert seen == [4] and set(out) == {(u, v) for u in ("p1", "p2") for v in ("w1", "w2")}
    assert out["p1", "w2"] == (0, [1, 5, 0]) and out["p2", "w2"][1] == [3, 5, 0]


def test_rounds_of_components_are_not_broadcast(spark, monkeypatch):
    """Tables of each round, small enough to broadcast, went through the driver."""
    plans, save = [], Workspace.save

    def watched(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df)

    monkeypatch.setattr(Workspace, "save", watched)
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "u long, v long")
    n = spark.createDataFrame([(1,), (2,), (3,)], "node_id long")
    assert sorted(tuple(r) for r in graph.strong_components(e, n).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert plans and not any("Broadcast" in p for p in plans)
