import random

import pytest
from pyspark.sql import functions as F

from gridweave.operators import dedup, features, graph, joins, layout, ordering, summaries, tables
from gridweave.operators.components import components
from gridweave.workspace import Workspace


def points(spark, n, seed, prefix):
    r = random.Random(seed)
    return spark.createDataFrame([(f"{prefix}{i}", i, r.uniform(0, 1000), r.uniform(0, 1000)) for i in range(n)] + [(f"{prefix}none", n, None, 1.0)], "id string, ord int, x double, y double")


def test_ring_search_is_brute_force(spark):
    t, s = points(spark, 200, 1, "t"), points(spark, 150, 2, "s")
    far = spark.createDataFrame([("far", 1, 90000.0, -90000.0)], t.schema)
    t = t.unionByName(far)
    a = joins.nearest(t.withColumnRenamed("id", "t"), s.withColumnRenamed("id", "s"), "t", "s", "ord")
    b = joins.nearest(t.withColumnRenamed("id", "t"), s.withColumnRenamed("id", "s"), "t", "s", "ord", broadcast_rows=10)
    key = lambda df: sorted((r.t, r.s, round(r.metres, 9)) for r in df.collect())
    assert key(a) == key(b) and a.count() == 201


def test_nearest_ties_go_to_the_first(spark):
    s = spark.createDataFrame([("b", 0, 0.0, 0.0), ("a", 1, 2.0, 0.0)], "s string, ord int, x double, y double")
    t = spark.createDataFrame([("t", 1.0, 0.0)], "t string, x double, y double")
    assert joins.nearest(t, s, "t", "s", "ord").first().s == "b"
    assert joins.nearest(t.limit(0), s, "t", "s", "ord").count() == 0


def test_radius_and_anti(spark):
    a, b = points(spark, 120, 3, "a"), points(spark, 80, 4, "b")
    rows = lambda df: [(r.id, r.x, r.y) for r in df.collect() if r.x is not None]
    want = {(p, q) for p, x, y in rows(a) for q, u, v in rows(b) if ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= 60}
    assert {(r.l_id, r.r_id) for r in joins.within_radius(a, b, 60.0).collect()} == want
    near = {p for p, _ in want}
    assert {r.id for r in joins.farther_than(a.where("x is not null"), b, 60.0, "id").collect()} == {p for p, *_ in rows(a)} - near


def test_places_round_as_floats_do(spark):
    """-73.99549999999999 is a half once multiplied by 1000, so it lies with -73.996, as in SQL."""
    rows = spark.createDataFrame([(1, 40.7, -73.99549999999999), (2, 40.7, -73.996), (3, 40.7, -73.995), (4, 1e307, 0.0)], "key int, lat double, lon double")
    kept = dedup.keep_nearby_first(rows, 3, F.lit(0), [F.col("key")])
    assert sorted(r.key for r in kept.collect()) == [1, 3, 4]


def test_crowded_cell_is_the_work_of_many_tasks(spark, monkeypatch):
    """All places within one radius were one cell, and so one task."""
    monkeypatch.setattr(joins, "TILE_ROWS", 20)
    monkeypatch.setattr(joins, "TASK_PAIRS", 1000)
    a, b = points(spark, 120, 3, "a").where("x is not null"), points(spark, 80, 4, "b").where("x is not null")
    pairs = joins.within_radius(a, b, 50_000.0).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in pairs) == 120 * 80
    assert max(r["count"] for r in pairs) < 120 * 80 / 3


def test_right_side_of_a_radius_is_sent_in_blocks(spark, monkeypatch):
    """Each row of it was sent alone to 25 cells, once for each part of theirs; places without an end broke the sums of cells."""
    a, b = points(spark, 90, 3, "a"), points(spark, 70, 4, "b")
    lone = spark.createDataFrame([("inf", 1, float("inf"), 0.0), ("nan", 3, float("nan"), 0.0)], a.schema)
    saved, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df: saved.append(save(self, df)) or saved[-1])
    monkeypatch.setattr(joins, "TILE_ROWS", 64)
    rows = lambda df: [(r.id, r.x, r.y) for r in df.collect() if r.x is not None]
    want = sorted((p, q) for p, x, y in rows(a) for q, u, v in rows(b) if ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= 400)
    assert sorted((r.l_id, r.r_id) for r in joins.within_radius(a.unionByName(lone), b.unionByName(lone), 400.0).collect()) == want
    blocks = next(df for df in saved if "_in" in df.columns)
    assert blocks.count() < 70 / 1.5 and blocks.select(F.sum(F.size("_in"))).first()[0] == 70
    assert joins.within_radius(a, a, 0.0).count() == 90


def test_anti_makes_no_pairs(spark, monkeypatch):
    """A target's nearest source says enough: pairs within the radius, all with all here, aren't made."""
    a, b = points(spark, 120, 3, "a").where("x is not null"), points(spark, 80, 4, "b")
    monkeypatch.setattr(joins, "within_radius", None)
    assert joins.farther_than(a, b, 5000.0, "id").count() == 0
    lone = spark.createDataFrame([("inf", 1, float("inf"), 0.0), ("none", 2, None, 0.0), ("nan", 3, float("nan"), 0.0)], a.schema)
    assert {r.id for r in joins.farther_than(a.unionByName(lone), b, 5000.0, "id").collect()} == {"inf", "none", "nan"}


def test_first_box_many_boxes(spark, monkeypatch):
    boxes = spark.createDataFrame([(i, i * 10.0, 0.0, i * 10.0 + 15, 1000.0) for i in range(90)], "division int, left double, bottom double, right double, top double")
    p = points(spark, 100, 5, "p").where("x is not null")
    few = {r.id: r.division for r in joins.first_box(p, boxes, "id").collect()}
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    assert {r.id: r.division for r in joins.first_box(p, boxes, "id").collect()} == few
    assert set(few.values()) - {-1}


def test_polygons_many(spark, monkeypatch):
    rings = [[[[float(i * 50), 0.0], [float(i * 50 + 60), 0.0], [float(i * 50 + 30), 900.0]]] for i in range(20)] + [None]
    polygons = spark.createDataFrame([(r,) for r in rings], "rings array<array<array<double>>>")
    p = points(spark, 200, 6, "p").where("x is not null")
    few = {r.id: r.inside for r in joins.inside_any_polygon(p, polygons, "id").collect()}
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    assert {r.id: r.inside for r in joins.inside_any_polygon(p, polygons, "id").collect()} == few
    assert len(set(few.values())) == 2


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(7, None)]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "src long, dst long"), Workspace(spark)).collect()}
    label = {}
    for u, v in edges:
        if v is not None and u != v:
            label.setdefault(u, u), label.setdefault(v, v)
    for _ in range(200):
        for u, v in edges:
            if v is not None and u != v:
                label[u] = label[v] = min(label[u], label[v])
    assert got == label
    assert components(spark.createDataFrame([], "src long, dst long"), Workspace(spark)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_strong_components(spark, seed):
    r = random.Random(seed)
    edges = {(r.randint(0, 25), r.randint(0, 25)) for _ in range(45)}
    nodes = range(30)
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for u, v in edges:
            for n in nodes:
                if u in reach[n]:
                    reach[n].add(v)
    want = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    got = graph.strong_components(spark.createDataFrame(list(edges), "u long, v long"), spark.createDataFrame([(n,) for n in nodes], "node_id long"))
    assert {x.node_id: x.component for x in got.collect()} == want


def test_ordinal_numbers_all_rows(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k")).repartition(6)
    got = ordering.ordinal(df, [F.col("k")], Workspace(spark))
    assert got.where("k <> ord").count() == 0 and got.count() == 500


def test_merge_keeps_earlier_attributes(spark):
    e = spark.createDataFrame([("a", "b", 1, "x", None), ("a", "b", 2, None, 5), ("a", "b", 3, "z", None)], "u string, v string, o int, p string, q int")
    r = dedup.last_write_wins(e, ["o"]).first()
    assert (r.p, r.q, r.first_ord.o) == ("z", 5, 1)


def test_confusion_without_positives(spark):
    df = spark.createDataFrame([(False, None), (None, False)], "p boolean, o boolean")
    r = summaries.confusion(df, F.col("p"), F.col("o")).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.recall, r.precision, r.accuracy) == (0, 0, 0, 2, 0.0, 0.0, 1.0)


def test_both_ways_and_union(spark):
    e = spark.createDataFrame([("a", "b", 1)], "u string, v string, w int")
    assert sorted((r.u, r.v, r.way, r.w) for r in tables.both_ways(e).collect()) == [("a", "b", 0, 1), ("b", "a", 1, 1)]
    assert tables.union_present([None, e.limit(0)]) is None


def test_scaled_vectors_of_constants(spark):
    df = spark.createDataFrame([("k", [1.0, 2.0]), ("k", [1.0, 4.0]), ("j", [9.0, 9.0])], "kind string, features array<float>")
    got = sorted((r.kind, tuple(r.features)) for r in features.scaled_vectors(df, "kind", width=2).collect())
    assert got == [("j", (0.0, 0.0)), ("k", (0.0, 0.0)), ("k", (0.0, 1.0))]


def test_layout_is_repeatable(spark):
    n = spark.createDataFrame([(f"n{i}", i) for i in range(12)], "node_id string, ord int")
    e = spark.createDataFrame([(f"n{i}", f"n{(i * 5 + 1) % 12}") for i in range(12)], "u string, v string")
    a, b = ({r.node_id: (round(r.x, 6), round(r.y, 6)) for r in layout.spring_layout(n, e, rounds=3).collect()} for _ in range(2))
    assert a == b and len(a) == 12


def _plain_nearest(targets, sources):
    return {t: min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, s) for s, a, b in sources) for t, x, y in targets}


def test_nearest_with_an_outlier_sees_few_sources(spark):
    """A city of sources and one 10,000 km away: the same rows, and under 200 boxes and sources a target."""
    import random

    from gridweave.operators import joins
    from gridweave.workspace import Workspace

    r = random.Random(8)
    sources = [(i, r.gauss(0, 5000), r.gauss(0, 5000)) for i in range(4999)] + [(4999, 1e7, 1e7)] + [(5000 + i, 50.0, 50.0) for i in range(40)]
    targets = [(i, r.gauss(0, 6000), r.gauss(0, 6000)) for i in range(300)] + [(300, 9e6, 9e6), (301, -4e6, 3e5), (302, 50.0, 50.0), (303, 51.0, 50.0)]
    t, s = spark.createDataFrame(targets, "t long, x double, y double"), spark.createDataFrame(sources, "s long, x double, y double")
    for rows in (joins.BROADCAST_ROWS, 2):
        found = {x.t: (x.metres, x.s) for x in joins.nearest(t, s, "t", "s", broadcast_rows=rows).collect()}
        want = _plain_nearest(targets, sources)
        assert {k: v[1] for k, v in found.items()} == {k: v[1] for k, v in want.items()}
    ws = Workspace(spark)
    placed, levels = joins.search_tree(s.selectExpr("s AS s_id", "s AS s_ord", "x AS sx", "y AS sy"), ws)
    leaves = joins.nearest_leaves(t.selectExpr("t AS t_id", "x AS tx", "y AS ty"), levels, len(sources), joins.BROADCAST_ROWS, ws)
    seen = [x["count"] for x in leaves.join(placed, "leaf").where("t_id < 301").groupBy("t_id").count().collect()]
    assert max(seen) < 200 and sum(seen) / len(seen) < 80
    ws.clear()


def test_nearest_of_odd_rows(spark):
    from gridweave.operators import joins

    nan = float("nan")
    s = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", None, 1.0), ("d", nan, 1.0)], "s string, x double, y double")
    t = spark.createDataFrame([(1, 1.0, 1.0), (1, 0.0, 2.0), (2, None, 1.0), (3, nan, nan), (None, 1.0, 1.0)], "t long, x double, y double")
    assert [(r.t, r.s) for r in joins.nearest(t, s, "t", "s").collect()] == [(1, "a")]
    assert joins.nearest(t, s.where("false"), "t", "s").count() == 0
    assert joins.nearest(t.where("false"), s, "t", "s").count() == 0
