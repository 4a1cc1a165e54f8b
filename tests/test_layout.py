"""Spring layout: forces against plain sums, and a layout truer to a grid than where it starts."""

import math
import re

import numpy as np

from gridweave.operators import layout


def test_repulsion_by_cells_is_near_the_sum_over_pairs(spark):
    r = np.random.RandomState(4)
    p = np.r_[r.uniform(0, 30, (500, 2)), r.normal(15, 0.5, (100, 2))]
    at = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "n long, x double, y double")
    found = {x.n: (x.fx, x.fy) for x in layout.repulsion(at, len(p)).collect()}
    d = p[:, None] - p[None]
    want = (d / np.maximum((d * d).sum(2), 1e-2)[:, :, None]).sum(1)
    got = np.array([found[i] for i in range(len(p))])
    error = np.sqrt(((got - want) ** 2).sum(1)) / np.sqrt((want**2).sum(1)).mean()
    assert np.median(error) < 0.1 and (got * want).sum(1).mean() > 0.8 * (want**2).sum(1).mean()


def _stress(place, far):
    """Mean square of (distance over steps less one), at the best scale."""
    ids = sorted(place)
    p = np.array([place[i] for i in ids])
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    g = np.array([[far(i, j) for j in ids] for i in ids], float)
    off = g > 0
    q = d[off] / g[off]
    return ((q * q.mean() / (q * q).mean() - 1) ** 2).mean()


def test_layout_of_a_grid_is_truer_than_a_spiral(spark):
    side = 12
    edges = [(i, i + 1) for i in range(side * side) if i % side < side - 1] + [(i, i + side) for i in range(side * (side - 1))]
    nodes = spark.range(side * side).withColumnRenamed("id", "node_id")
    e = spark.createDataFrame([*edges, (0, 0), (3, 9999), (None, 1)], "u long, v long")
    out = layout.spring_layout(nodes.unionByName(nodes.limit(3)), e, rounds=6)
    place = {r.node_id: (r.x, r.y) for r in out.collect()}
    assert sorted(place) == list(range(side * side)) and out.count() == side * side
    far = lambda i, j: abs(i // side - j // side) + abs(i % side - j % side)
    spiral = {i: (math.sqrt(i + 1) * math.cos(i * 2.399963), math.sqrt(i + 1) * math.sin(i * 2.399963)) for i in range(side * side)}
    assert _stress(place, far) < 0.5 * _stress(spiral, far)


def test_layout_of_little(spark):
    nodes = spark.createDataFrame([("a",), (None,)], "node_id string")
    edges = spark.createDataFrame([("a", "a")], "u string, v string")
    assert [r.node_id for r in layout.spring_layout(nodes, edges).collect()] == ["a"]
    assert layout.spring_layout(nodes.where("false"), edges).count() == 0


def test_repulsion_deals_cells_and_not_nodes(spark):
    at = spark.range(400).selectExpr("id as n", "cast(id % 20 as double) as x", "cast(id div 20 as double) as y")
    lines = layout.repulsion(at, 400)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    dealt = [i for i, line in enumerate(lines) if "Generate explode" in line]
    assert dealt and not any(re.search(r"\bn#", lines[i + 1]) for i in dealt)
