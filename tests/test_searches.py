"""Exact predicates, crossings, inscribed spheres and edge paths against plain computations."""

import heapq
import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from meshloom.functions import kernels as K
from meshloom.functions import predicates as X
from meshloom.operators import cases as C
from meshloom.operators import histogram as H
from meshloom.operators import spatial as P
from meshloom.operators import surface as S
from meshloom.plans.surfaces import box_surface
from tests.test_hierarchy import ball


def exact(points):
    """Sign of the determinant of differences from the last point."""
    rows = [[Fraction(x) - Fraction(y) for x, y in zip(p, points[-1], strict=True)] for p in points[:-1]]
    if len(rows) == 2:
        det = rows[0][0] * rows[1][1] - rows[0][1] * rows[1][0]
    else:
        (a, b, c), (d, e, f), (g, h, i) = rows
        det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return (det > 0) - (det < 0)


@pytest.mark.parametrize("size", [2, 3])
def test_orientation_is_exact(size):
    rng = np.random.default_rng(4)
    free = rng.normal(size=(200, size + 1, size))
    # points a rounding away from a line or plane, at very different scales
    near = rng.normal(size=(600, size + 1, size)) * 2.0 ** rng.integers(-30, 30, (600, 1, 1))
    weights = rng.dirichlet(np.ones(size), 600)
    near[:, -1] = (near[:, :-1] * weights[:, :, None]).sum(1)
    whole = rng.integers(-3, 4, (400, size + 1, size)).astype(float)
    tiny = whole * 1e-200 + 1e-190
    for p in (free, near, whole, tiny):
        found = X.orientation(*(p[:, i] for i in range(size + 1)))
        assert found.tolist() == [exact(x.tolist()) for x in p]
    assert len({*X.orientation(*(near[:, i] for i in range(size + 1))).tolist()}) > 1


def cross(p, q, vp=(0, 1, 2), vq=(3, 4, 5)):
    return bool(X.triangles_cross(*(np.array([x], float) for x in (p, q)), *(np.array([x]) for x in (vp, vq)))[0][0])


def test_triangles_that_cross():
    flat = [(0, 0, 0), (4, 0, 0), (0, 4, 0)]
    assert cross(flat, [(1, 1, -1), (1, 1, 1), (5, 5, 0)]) and not cross(flat, [(1, 1, 1), (1, 2, 1), (5, 5, 2)])
    assert cross(flat, [(1, 1, 0), (1, 1, 5), (2, 2, 5)]) and cross(flat, [(1, 1, 0), (2, 1, 0), (1, 2, 0)])  # a corner on it; one inside it
    assert cross(flat, [(2, 2, 0), (4, 4, 0), (4, 4, 1)]) and not cross(flat, [(2, 2.0000000000000004, 0), (4, 4, 0), (4, 4, 1)])
    # a common corner: apart, through each other, and one in the plane of the other
    assert not cross(flat, [(0, 0, 0), (-1, 0, 1), (0, -1, 1)], vq=(0, 4, 5))
    assert cross(flat, [(0, 0, 0), (1, 1, -1), (1, 1, 1)], vq=(0, 4, 5)) and cross(flat, [(0, 0, 0), (1, 2, 0), (2, 1, 0)], vq=(0, 4, 5))
    assert not cross(flat, [(0, 0, 0), (-1, -2, 0), (-2, -1, 0)], vq=(0, 4, 5))
    # a common side: bent, folded flat, and side by side
    assert not cross(flat, [(0, 0, 0), (4, 0, 0), (0, 1, 3)], vq=(0, 1, 5))
    assert cross(flat, [(4, 0, 0), (0, 0, 0), (3, 3, 0)], vq=(1, 0, 5)) and not cross(flat, [(4, 0, 0), (0, 0, 0), (3, -3, 0)], vq=(1, 0, 5))
    assert cross(flat, flat, vq=(2, 0, 1)) and not cross(flat, [(1, 1, -1), (1, 1, 0), (1, 1, 1)])


def test_crossings_of_random_triangles(spark):
    """Against points: two closed triangles meet if and only if a linear program finds a common point; here by dense clipping."""
    rng = random.Random(8)
    points = [tuple(float(rng.randint(0, 5)) for _ in range(3)) for _ in range(60)]
    faces = [[rng.randrange(60) for _ in range(3)] for _ in range(50)]
    faces = [v for v in faces if len(set(v)) == 3 and len({points[i] for i in v}) == 3]
    sv = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "vid long, x double, y double, z double")
    sf = spark.createDataFrame(list(enumerate(faces)), "fid long, v array<long>")
    found = {(r.a, r.b): r.shared for r in P.crossings(S.corners(sv, sf)).collect()}
    tri = np.array([[points[i] for i in v] for v in faces])
    n = len(faces)
    a, b = (x.ravel() for x in np.meshgrid(range(n), range(n), indexing="ij"))
    a, b = a[a < b], b[a < b]
    hit, shared = X.triangles_cross(tri[a], tri[b], np.array(faces)[a], np.array(faces)[b])
    assert found == {(int(x), int(y)): int(s) for x, y, h, s in zip(a, b, hit, shared, strict=True) if h}
    # pairs without common corners, by the old test in doubles, which misses touching ones only
    for x, y, h, s in zip(a, b, hit, shared, strict=True):
        if s == 0 and any(K.segment_hits(p[i : i + 1], p[(i + 1) % 3][None], q[None])[0, 0] for p, q in ((tri[x], tri[y]), (tri[y], tri[x])) for i in range(3)) and X.plane_axis(tri[[x, y]]).min() >= 0:
            assert h


def test_folded_surfaces_are_refused(spark):
    sv, sf = box_surface(spark)
    assert C.valid_for_queries(sv, sf) is None
    folded = sv.selectExpr("vid", "x", "y", "CASE WHEN vid = 7 THEN -0.9 ELSE z END AS z")  # a corner pulled through the bottom
    assert "cross" in C.valid_for_queries(folded, sf)


def test_spheres_in_a_ball(spark):
    triangles = ball(24)
    names = [f"{p}_{c}" for p in "abc" for c in "xyz"]
    faces = spark.createDataFrame(pd.DataFrame(triangles.reshape(-1, 9), columns=names).assign(fid=range(len(triangles))))
    rows = P.inscribed(faces).toPandas()
    # near the small holes at the poles spheres are held by their rims
    assert len(rows) == len(triangles) and rows.diameter.max() < 2.001 and rows.diameter.min() > 0.5 and (rows.diameter > 1.8).mean() > 0.85, rows.diameter.describe()
    assert P.inscribed(faces.limit(0)).count() == 0


def test_edge_paths_by_search(spark):
    rng = np.random.default_rng(3)
    m = 9
    points = [(float(i), float(j), float(rng.uniform(0, 1))) for i in range(m) for j in range(m)]
    faces = [v for i in range(m - 1) for j in range(m - 1) for k in [i * m + j] for v in ([k, k + m, k + m + 1], [k, k + m + 1, k + 1])]
    near = {}
    for v in faces:
        for a, b in zip(v, v[1:] + v[:1], strict=True):
            near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = math.dist(points[a], points[b])
    records = [(i, int(rng.integers(len(faces))) if i % 7 else None, float(rng.uniform(0.1, 3))) for i in range(len(faces))]

    def path(a, b, most):
        best, heap = dict.fromkeys(faces[a], 0.0), [(0.0, v) for v in faces[a]]
        while heap:
            d, v = heapq.heappop(heap)
            if v in faces[b]:
                return d
            for w, length in near[v].items():
                if d + length <= most and d + length < best.get(w, math.inf):
                    best[w] = d + length
                    heapq.heappush(heap, (d + length, w))
        return -1.0

    sv = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "vid long, x double, y double, z double")
    sf = spark.createDataFrame(list(enumerate(faces)), "fid long, v array<long>")
    found = {r.fid: r.topo for r in C.topological_distances(S.corners(sv, sf), spark.createDataFrame(records, "fid long, opposite long, diameter double"), 8.0).collect()}
    wanted = {i: -1.0 if b is None else path(i, b, max(math.pi * d, 0.005 * 8)) for i, b, d in records}
    assert found.keys() == wanted.keys() and all(math.isclose(found[i], wanted[i], rel_tol=1e-12) for i in found)
    assert any(x > 3 for x in wanted.values()) and 0.0 in wanted.values()


@pytest.mark.parametrize("extra", [[], [math.nan], [math.nan, math.inf, -math.inf, None, math.nan]])
def test_places_with_odd_values(spark, extra):
    values = [5.0, 1.0, 9.0, 3.0, 3.0, 7.0, 2.0, 8.0, 6.0, *extra]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    order = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    plain = lambda v: "nan" if v is not None and v != v else v
    for k in range(len(order)):
        assert plain(H.nth_value(rows, "v", k)) == plain(order[k])
        assert plain(H.nth_value(rows, "v", k, descending=True)) == plain(order[::-1][k])
    assert H.nth_value(rows, "v", len(order)) is None
    assert plain(H.upper_median(rows, "v").first()[0]) == plain(order[len(order) // 2])
