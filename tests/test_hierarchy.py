"""Searches down a hierarchy of boxes against brute force, and how much they look at."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshloom.functions import kernels as K
from meshloom.operators import hierarchy as H

CORNERS = [f"{p}_{c}" for p in "abc" for c in "xyz"]


def ball(n):
    """2 n^2 triangles of a sphere by latitude and longitude."""
    u, v = np.linspace(0.02, np.pi - 0.02, n + 1), np.linspace(0, 2 * np.pi, n + 1)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))

    def point(i, j):
        return np.stack([np.sin(u[i]) * np.cos(v[j]), np.sin(u[i]) * np.sin(v[j]), np.cos(u[i])], axis=1)

    a, b, c, d = point(i, j), point(i + 1, j), point(i + 1, j + 1), point(i, j + 1)
    return np.concatenate([np.stack([a, b, c], axis=1), np.stack([a, c, d], axis=1)])


def frame(spark, triangles):
    return spark.createDataFrame(pd.DataFrame(triangles.reshape(-1, 9), columns=CORNERS).assign(fid=range(len(triangles))))


def queries(spark, n=200):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(n, 3))
    p *= (rng.uniform(0.6, 1.6, n) / np.sqrt((p * p).sum(1)))[:, None]
    d = rng.normal(size=(n, 3))
    d[:20, 0] = 0.0
    d[:10, 1] = 0.0
    rows = pd.DataFrame(np.hstack([p, d]), columns=["x", "y", "z", "dx", "dy", "dz"]).assign(id=range(n))
    return p, d, spark.createDataFrame(rows)


@pytest.mark.parametrize("sent", [1 << 17, 4])
def test_searches_find_what_brute_force_finds(spark, monkeypatch, sent):
    monkeypatch.setattr(H, "MOST_SENT", sent)
    triangles = ball(17)
    tree = H.hierarchy(frame(spark, triangles))
    p, d, rows = queries(spark)
    gaps, _ = K.closest_on_triangles(p, triangles)
    found = H.nearest(rows.select("id", "x", "y", "z"), tree).orderBy("id").toPandas()
    assert np.allclose(found.distance, np.sqrt(gaps.min(1)))
    hits = K.ray_hits(p, d, triangles)
    hits[hits <= 1e-12] = np.inf
    found = H.first_hits(rows, tree).orderBy("id").toPandas()
    assert np.allclose(found.distance.astype(float).fillna(np.inf), hits.min(1))
    ends = rows.select("id", "x", "y", "z", *[(F.col(c) + F.col(f"d{c}")).alias(f"e{c}") for c in "xyz"])
    found = H.segments_hit(ends, tree).orderBy("id").toPandas()
    assert (found.hit == (K.ray_hits(p, d, triangles) <= 1).any(1)).all()


def test_what_a_query_meets_does_not_grow_with_the_surface(spark):
    met = {}
    p, _, rows = queries(spark)
    for n in (64, 256):  # 8,192 and 131,072 triangles
        tree = H.hierarchy(frame(spark, ball(n)))
        inf = F.lit(float("inf")).alias("_bound")
        far = H.near_triangles(rows.select("id", "x", "y", "z", inf), tree).count() / 200
        size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
        close = H.near_triangles(rows.select("id", *[(F.col(c) / size * (1 + 0.1 / n)).alias(c) for c in "xyz"], inf), tree).count() / 200
        met[n] = close, H.crossed_boxes(rows.withColumn("most", F.lit(float("inf"))), tree).count() / 200, far
    assert all(met[256][k] < 1.5 * met[64][k] < 100 for k in (0, 1)) and met[256][2] < 4.5 * met[64][2], met


def test_edges_of_searches(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (2, None, 0.0, 0.0, 1.0, 0.0, 0.0)], "id long, x double, y double, z double, dx double, dy double, dz double")
    one = np.array([[[1.0, -1, -1], [1, 1, -1], [1, 0, 1]]])
    none = frame(spark, one).limit(0)
    assert H.hierarchy(none) is None and H.nearest(rows, none).count() == 0
    assert [r.distance for r in H.first_hits(rows, none).collect()] == [None, None]
    # repeated triangles: the lowest; corners that are no numbers take no part
    many = frame(spark, np.concatenate([np.repeat(one, 20, axis=0), [[[np.nan, 0, 0], [0, 0, 0], [0, 1, 0]]]]))
    assert [(r.id, r.distance, r.fid) for r in H.nearest(rows, many).collect()] == [(1, 1.0, 0)]
    assert {(r.id, r.distance, r.fid) for r in H.first_hits(rows, many).collect()} == {(1, 1.0, 0), (2, None, None)}
