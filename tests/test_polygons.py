"""Valid polygons against plain areas and a plain check of validity."""

import itertools
import random
from collections import Counter

import pytest

from gridweave.operators import polygons as ops
from gridweave.operators.polygons import make_valid, valid_rings

SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]
CASES = {
    "bow_tie": ([[[0, 0], [2, 2], [2, 0], [0, 2]]], 2, 2.0),
    "square": ([SQUARE], 1, 16.0),
    "closed": ([[*SQUARE, SQUARE[0]]], 1, 16.0),
    "overlapping": ([SQUARE, [[2, 2], [6, 2], [6, 6], [2, 6]]], 2, 24.0),
    "hole": ([SQUARE, [[1, 1], [2, 1], [2, 2], [1, 2]]], 2, 15.0),
    "hole_at_corner": ([SQUARE, [[0, 0], [2, 1], [1, 2]]], 2, 14.5),
    "hole_at_edge": ([SQUARE, [[0, 2], [2, 1], [2, 3]]], 2, 14.0),
    "shared_edge": ([SQUARE, [[4, 0], [8, 0], [8, 4], [4, 4]]], 1, 32.0),
    "twice": ([SQUARE, SQUARE], 0, 0.0),
    "spike": ([[[0, 0], [4, 0], [4, 4], [9, 4], [4, 4], [0, 4]]], 1, 16.0),
    "line": ([[[0, 0], [3, 3]]], 0, 0.0),
    "nulls": ([None, SQUARE, [[None, 1], [2, None]]], 1, 16.0),
    "empty": ([], 0, 0.0),
    "island": ([[[0, 0], [9, 0], [9, 9], [0, 9]], [[1, 1], [8, 1], [8, 8], [1, 8]], [[2, 2], [7, 2], [7, 7], [2, 7]], [[3, 3], [4, 3], [4, 4], [3, 4]]], 4, 81 - 49 + 25 - 1.0),
}


def cut_area(rings):
    """Area by the even-odd rule: between the heights where anything begins, ends or crosses, in strips."""
    segs = [(a[0], a[1], b[0], b[1]) for r in rings if r for a, b in zip(r, r[1:] + r[:1], strict=True)]
    ys = {y for s in segs for y in (s[1], s[3])}
    for (a, b, c, d), (e, f, g, h) in itertools.combinations(segs, 2):
        det = (c - a) * (h - f) - (d - b) * (g - e)
        if det:
            t = ((e - a) * (h - f) - (f - b) * (g - e)) / det
            if 0 <= t <= 1:
                ys.add(b + t * (d - b))
    ys = sorted(ys)
    total = 0.0
    for lo, hi in zip(ys, ys[1:], strict=False):
        mid = (lo + hi) / 2
        xs = sorted(a + (mid - b) * (c - a) / (d - b) for a, b, c, d in segs if (b > mid) != (d > mid))
        total += (hi - lo) * sum(y - x for x, y in zip(xs[::2], xs[1::2], strict=True))
    return total


def plain_faults(rings):
    """What a valid set of rings doesn't have: points that a ring comes to twice, pieces that cross or lie on one another."""
    segs = [(tuple(a), tuple(b)) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)]
    faults = [p for r in rings for p, n in Counter(map(tuple, r)).items() if n > 1]
    for (a, b), (c, d) in itertools.combinations(segs, 2):
        side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        s = [side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)]
        if s[0] * s[1] < -1e-12 and s[2] * s[3] < -1e-12 or {a, b} == {c, d}:
            faults.append((a, b, c, d))
    return faults


def polygons(spark, cases):
    return spark.createDataFrame([(k, r, "clash", "clash") for k, r in cases], "key string, rings array<array<array<double>>>, ring string, sid string")


def test_make_valid_cases(spark):
    floats = lambda rings: [None if r is None else [[None if v is None else float(v) for v in p] for p in r] for r in rings]
    df = polygons(spark, [(k, floats(r)) for k, (r, _, _) in CASES.items()] + [("null", None)])
    found = {r.key: r for r in make_valid(df, "key").collect()}
    assert set(found) == {k for k, (_, n, _) in CASES.items() if n}
    for k, row in found.items():
        assert len(row.rings) == CASES[k][1], (k, row.rings)
        assert row.area == pytest.approx(CASES[k][2]), k
        assert not plain_faults(row.rings), (k, row.rings)
        assert cut_area(row.rings) == pytest.approx(CASES[k][2]), k
    assert [len(p) for p in found["island"].parts] in ([2, 2],)
    assert [len(p) for p in found["hole_at_corner"].parts] == [2]
    assert [len(p) for p in found["bow_tie"].parts] == [1, 1]


def test_make_valid_of_random_rings(spark):
    r = random.Random(6)
    cases = [(str(i), [[[float(r.randint(0, 12)), float(r.randint(0, 12))] for _ in range(r.randint(3, 14))] for _ in range(r.randint(1, 3))]) for i in range(60)]
    found = {x.key: x for x in make_valid(polygons(spark, cases), "key").collect()}
    for k, rings in cases:
        want = cut_area(rings)
        assert (found[k].area if k in found else 0.0) == pytest.approx(want, abs=1e-6), (k, rings)
        if k in found:
            assert not plain_faults(found[k].rings), (k, rings)


def test_valid_rings_of_nothing(spark):
    assert valid_rings(polygons(spark, []), "key").count() == 0


def test_polygons_are_made_valid_in_rounds(spark, monkeypatch):
    """Tables of a round are deleted before the next."""
    rows = [(k, [[[0.0, 0.0], [k + 1.0, 0.0], [k + 1.0, 1.0], [0.0, 1.0]]]) for k in range(3)] + [(3, None)]
    df = spark.createDataFrame(rows, "key long, rings array<array<array<double>>>")
    monkeypatch.setattr(ops, "ROUND_POINTS", 10)
    assert {r.key: round(r.area, 6) for r in ops.make_valid(df, "key").collect()} == {k: k + 1.0 for k in range(3)}


@pytest.mark.parametrize("row_segments", [256, 6, 0])
def test_areas_of_what_is_covered(spark, monkeypatch, row_segments):
    """Areas without rings, of polygons within a row and by cells, to the twelfth decimal; those of rings are rounded at the corners."""
    r = random.Random(8)
    cases = [(str(i), [[[float(r.randint(0, 12)), float(r.randint(0, 12))] for _ in range(r.randint(3, 14))] for _ in range(r.randint(1, 3))]) for i in range(80)]
    floats = lambda rings: [None if p is None else [[None if v is None else float(v) for v in q] for q in p] for p in rings]
    cases += [(k, floats(p)) for k, (p, _, _) in CASES.items()]
    far = [[x + 1000.25, y - 2000.5] for x, y in cases[0][1][0]]
    df = polygons(spark, [*cases, ("null", None), ("far", [far]), (None, [SQUARE]), ("parts", [SQUARE]), ("parts", [[[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0]]])])
    monkeypatch.setattr(ops, "ROW_SEGMENTS", row_segments)
    found = {x.key: x.area for x in ops.covered_areas(df, "key").collect()}
    for k, rings in cases:
        rings = [[p for p in q if None not in p] for q in rings if q]
        assert found.get(k, 0.0) == pytest.approx(cut_area(rings), abs=1e-11), (k, rings)
    assert found["parts"] == pytest.approx(15.0, abs=1e-11) and found["far"] == pytest.approx(cut_area([far]), abs=1e-7)
    assert "null" not in found
