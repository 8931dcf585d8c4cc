"""Polygon nesting and union against counted cells and simple cases."""

import random

import pytest
from pyspark.sql import functions as F

from meshloom.operators import polygons as G


def frame(spark, rings):
    return spark.createDataFrame([(i, [(float(x), float(y)) for x, y in p]) for i, p in rings], "id long, p array<struct<x: double, y: double>>")


def rectangle(x, y, w, h, back=False):
    p = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    return p[::-1] if back else p


def loops(spark, rings):
    rows = G.loop_measures(G.union(frame(spark, rings))).collect()
    return sorted(round(r.area, 6) for r in rows)


def test_union_of_overlapping_and_touching_polygons(spark):
    assert loops(spark, [(0, rectangle(0, 0, 2, 2)), (1, rectangle(1, 1, 2, 2))]) == [7.0]
    # a common stretch of a side, one within the other, one twice, and one apart
    assert loops(spark, [(0, rectangle(0, 0, 2, 2)), (1, rectangle(2, 1, 1, 3)), (2, rectangle(0.5, 0.5, 1, 1)), (3, rectangle(0, 0, 2, 2)), (4, rectangle(9, 9, 1, 1))]) == [1.0, 7.0]
    # parts that touch in a point are one loop; a frame of four has a hole
    assert loops(spark, [(0, rectangle(0, 0, 1, 1)), (1, rectangle(1, 1, 1, 1))]) == [2.0]
    frame_ = [rectangle(0, 0, 4, 1), rectangle(0, 3, 4, 1), rectangle(0, 0, 1, 4), rectangle(3, 0, 1, 4)]
    assert loops(spark, list(enumerate(frame_))) == [-4.0, 16.0]
    # slanted sides, and a hole that another polygon fills in part
    star = [(0, [(0, 0), (6, 0), (3, 6)]), (1, [(0, 4), (3, -2), (6, 4)])]
    assert len(loops(spark, star)) == 1
    assert loops(spark, [(0, rectangle(0, 0, 5, 5)), (0, rectangle(1, 1, 3, 3, back=True)), (1, rectangle(2, 2, 1, 1))]) == [-9.0, 1.0, 25.0]


@pytest.mark.parametrize("seed", [1, 2])
def test_union_by_counted_cells(spark, seed):
    rng = random.Random(seed)
    rings = [(i, rectangle(rng.randint(0, 14), rng.randint(0, 14), rng.randint(1, 5), rng.randint(1, 5))) for i in range(25)]
    cells = {(x, y) for _, p in rings for x in range(p[0][0], p[2][0]) for y in range(p[0][1], p[2][1])}

    def parts(left, near):
        n = 0
        while left:
            n, todo = n + 1, [left.pop()]
            while todo:
                x, y = todo.pop()
                for q in {(x + i, y + j) for i, j in near} & left:
                    left.remove(q)
                    todo.append(q)
        return n

    sides = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    outside = {(x, y) for x in range(-1, 22) for y in range(-1, 22)} - cells
    found = loops(spark, rings)
    assert sum(found) == len(cells)
    assert sum(a > 0 for a in found) == parts(set(cells), [*sides, (1, 1), (1, -1), (-1, 1), (-1, -1)])
    assert sum(a < 0 for a in found) == parts(outside, sides) - 1


def test_nesting(spark):
    rings = [(1, rectangle(0, 0, 10, 10)), (2, rectangle(1, 1, 8, 8, back=True)), (3, [(2, 2), (6, 2), (4, 6)]), (4, rectangle(3.5, 2.5, 0.5, 0.5)), (5, rectangle(6, 4, 1, 1)), (6, rectangle(20, 0, 1, 1)), (7, rectangle(0, 0, 10, 10))]
    assert {r.id: (r.parent, r.depth) for r in G.nesting(frame(spark, rings)).collect()} == {1: (None, 0), 7: (1, 1), 2: (7, 2), 3: (2, 3), 4: (3, 4), 5: (2, 3), 6: (None, 0)}
    # a box that holds a ring's box need not hold the ring
    assert {r.id: r.depth for r in G.nesting(frame(spark, [(1, [(0, 0), (10, 0), (0, 10)]), (2, rectangle(7, 7, 1, 1)), (3, rectangle(1, 1, 1, 1))])).collect()} == {1: 0, 2: 0, 3: 1}
    none = frame(spark, rings).limit(0)
    assert G.nesting(none).count() == 0 and G.union(none).count() == 0
    assert [tuple(r) for r in G.areas(frame(spark, rings[:2])).orderBy("id").collect()] == [(1, 100.0, 4), (2, -64.0, 4)]
    assert frame(spark, rings).where(F.size("p") == 3).count() == 1


def test_points_meet_only_sides_of_rings_that_reach_them(spark, monkeypatch):
    """Rings in one column: each meets itself and what is around it, however many lie above and below."""
    met, slabs = [], G._slabs

    def counted(points, lines):
        out = slabs(points, lines)
        met.append(out.count())
        return out

    monkeypatch.setattr(G, "_slabs", counted)
    rings = [(2 * k + s, rectangle(s, 10 * k + s, 4 - 2 * s, 4 - 2 * s)) for k in range(40) for s in (0, 1)]
    found = {r.id: (r.parent, r.depth) for r in G.nesting(frame(spark, rings)).collect()}
    assert found == {2 * k + s: ((None, 0), (2 * k, 1))[s] for k in range(40) for s in (0, 1)}
    assert met[0] <= 80 * 4 * 8


def test_union_takes_equal_and_overlapping_stretches_once(spark, monkeypatch):
    """Rectangles on a few places: what is crossed is bounded by the places, however many rectangles lie there."""
    crossed, crossings = [], G._crossings

    def counted(lines):
        crossed.append(lines.count())
        return crossings(lines)

    monkeypatch.setattr(G, "_crossings", counted)
    rng = random.Random(3)
    rings = [(i, rectangle(rng.randint(0, 5) / 4, rng.randint(0, 5) / 4, rng.randint(1, 3) / 4, rng.randint(1, 3) / 4)) for i in range(300)]
    assert loops(spark, rings) == [4.0]
    assert crossed[0] <= 2 * 9 * 8
    # twice a frame with a hole, of which slanted sides and a part are covered once more
    hole = [(0, 0), (9, 0), (9, 9), (0, 9)], [(1, 1), (1, 8), (8, 8), (8, 1)]
    rings = [(i, p) for i in range(2) for p in hole] + [(i, [(4, 4), (5, 4), (4, 6)]) for i in (2, 3)]
    assert loops(spark, rings) == [-49.0, 1.0, 81.0]
