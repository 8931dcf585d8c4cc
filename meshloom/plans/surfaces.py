"""Queries of surface analysis and spatial joins: a cube from constants, points and triangles from embeddings, a circle from events."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions import vectors as V
from meshloom.operators import spatial as P
from meshloom.operators import surface as S
from meshloom.operators import topology as T
from meshloom.plans.mesh import rounded, table

CUBE = [(x - 0.5, y - 0.5, z - 0.5) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
#: Twelve triangles of a cube, outward.
CUBE_FACES = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
SCALE = 4.0


def box_surface(spark: SparkSession, size=(1.0, 1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    sv = spark.createDataFrame([(i, *(float(a * s) for a, s in zip(p, size, strict=True))) for i, p in enumerate(CUBE)], "vid long, x double, y double, z double")
    return sv, spark.createDataFrame([(i, list(f)) for i, f in enumerate(CUBE_FACES)], "fid long, v array<long>")


def cube(spark: SparkSession) -> DataFrame:
    return S.corners(*box_surface(spark))


def component(i: int):
    return F.element_at("embedding", i + 1).cast("double")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z): the first three components of each embedding, scaled to reach beyond the cube."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[(component(i) * SCALE).alias(c) for i, c in enumerate("xyz")])


def boxes(spark: SparkSession, sf_dir: str, first: int) -> DataFrame:
    parts = []
    for i, c in enumerate("xyz"):
        half = F.abs(component(first + 3 + i)) / 4
        parts += [(component(first + i) - half).alias(f"lo_{c}"), (component(first + i) + half).alias(f"hi_{c}")]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *parts)


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fid, a_x .. c_z): three consecutive triples of each embedding; every tenth one has two equal corners."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fid"), *[component(3 * k + i).alias(f"{p}_{c}") for k, p in enumerate("abc") for i, c in enumerate("xyz")])
    flat = F.col("fid") % 10 == 0
    return rows.withColumns({f"c_{c}": F.when(flat, F.col(f"b_{c}")).otherwise(F.col(f"c_{c}")) for c in "xyz"})


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = [component(10 + i) for i in range(3)]
    return points(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[x.alias(f"d{c}") for x, c in zip(d, "xyz", strict=True)]), "id")


def circle_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    theta = 2 * math.pi * (F.hour("ts") * 60 + F.minute("ts")) / 1440.0
    r = 10.0 + F.pmod("event_id", F.lit(7)) / 70.0
    return table(spark, sf_dir, "events").select((3.0 + r * F.cos(theta)).alias("x"), (-2.0 + r * F.sin(theta)).alias("y"))


def unit_cells(spark: SparkSession) -> DataFrame:
    """(id, lo_x .. hi_z): 64 cells of a grid around the origin."""
    i = [F.pmod(F.floor(F.col("id") / 4**k), F.lit(4)) for k in range(3)]
    parts = []
    for k, c in enumerate("xyz"):
        parts += [(i[k] * 0.25 - 0.5).alias(f"lo_{c}"), (i[k] * 0.25 - 0.25).alias(f"hi_{c}")]
    return spark.range(64).select("id", *parts)


def triangle_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.measures(triangles(spark, sf_dir))
    return rounded(rows.select("fid", "area", "aspect", "least_edge", "most_edge", "least_angle"), "area", "least_edge", "most_edge").withColumns({"aspect": F.round("aspect", 3), "least_angle": F.round("least_angle", 4)})


def clip_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube's surface inside the cells of a grid that covers it: the pieces add up to its area."""
    from meshloom.operators import generate as G
    from meshloom.operators import monitor as M

    nodes, cells = G.box_nodes(spark, (-0.7, -0.7, -0.7), (1.4, 1.4, 1.4), (2, 2, 2)), G.box_cells(spark, (2, 2, 2))
    faces = cube(spark)
    pairs = P.overlap_join(M.cell_bounds(nodes, cells).withColumnRenamed("cid", "id"), P.triangle_boxes(faces), 0.7)
    pieces = P.clip_cells(T.corners_of(cells, nodes), faces, pairs)
    return pieces.where("itype = 3").agg(F.round(F.sum("area"), 6).alias("area"))


def keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.operators import generate as G

    n = (6, 6, 6)
    nodes, cells = G.box_nodes(spark, (-1.2, -1.2, -1.2), (2.4, 2.4, 2.4), n), G.box_cells(spark, n)
    return P.outcome_counts(P.keep_cells(T.corners_of(cells, nodes), cube(spark)))


def refine_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.operators import generate as G
    from meshloom.operators.refine import refine_uniformly

    size = (table(spark, sf_dir, "supplier").count() // 8 + 1, 1, 1)
    nodes, cells = G.box_nodes(spark, (0, 0, 0), size, size), G.box_cells(spark, size)
    for _ in range(2):
        nodes, cells = refine_uniformly(nodes, cells)
    shared = T.owners(cells).agg(F.max("n").alias("most_owners"), F.count(F.lit(1)).alias("n_faces"))
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes")).withColumn("k", F.lit(1))
    m = cells.agg(F.count(F.lit(1)).alias("n_cells")).withColumn("k", F.lit(1))
    return n.join(m, "k").join(shared.withColumn("k", F.lit(1)), "k").drop("k")


def deform_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.operators import generate as G
    from meshloom.operators.deform import deform

    n = (4, 4, 4)
    nodes, cells = G.box_nodes(spark, (-1, -1, -1), (2, 2, 2), n), G.box_cells(spark, n)
    far = lambda now: P.signed_distances(now.select(F.col("vid").alias("id"), "x", "y", "z"), cube(spark)).withColumnRenamed("id", "vid")
    return rounded(deform(nodes, cells, far, (-1, -1, -1), (2, 2, 2), 2), "x", "y", "z")


QUERIES = {
    "bbox_points": lambda s, d: rounded(S.mesh_size(points(s, d)), *[f"{a}_{c}" for a in ("lo", "hi") for c in "xyz"], "size"),
    "tri_shapes": triangle_shapes,
    "degenerate": lambda s, d: triangles(s, d).where(S.degenerate()).select("fid"),
    "small_area": lambda s, d: triangles(s, d).where(S.small_area(1.0, 0.005)).select("fid"),
    "mesh_warnings": lambda s, d: S.warnings(triangles(s, d)),
    "cube_summary": lambda s, d: T.surface_summary(box_surface(s)[1]),
    "cube_orientation": lambda s, d: rounded(S.orientation(cube(s)), "volume"),
    "cube_dihedral": lambda s, d: rounded(S.dihedral(cube(s)), "dihedral"),
    "cube_neighbors": lambda s, d: T.triangle_neighbors(box_surface(s)[1]),
    "circle_fit": lambda s, d: rounded(S.circle_fit(circle_points(s, d)), "cx", "cy", "r"),
    "extrusion_samples": lambda s, d: rounded(S.extrusions(points(s, d), [(1, (0, 0, 0), (0, 0, 2)), (2, (0.5, 0, 0), (-1, 0, 0)), (3, (9, 9, 9), (-1, -1, -1))]), "depth"),
    "nearest_point": lambda s, d: rounded(P.nearest(points(s, d), cube(s)).select("id", "distance"), "distance"),
    "point_triangle_distance": lambda s, d: rounded(
        triangles(s, d).select("fid", F.sqrt(V.point_triangle_distance2(V.lits(0.3, 0.2, 0.1), *S.abc())).alias("distance")), "distance"
    ),
    "sphere_hits": lambda s, d: P.sphere_hits(points(s, d).withColumn("r", 0.1 + F.pmod("id", F.lit(5)) / 10), cube(s)),
    "inside_parity": lambda s, d: P.inside(points(s, d), cube(s)),
    "ray_first_hit": lambda s, d: rounded(P.first_hits(rays(s, d), cube(s)).select("id", "distance"), "distance"),
    "aabb_overlap_join": lambda s, d: P.overlap_join(boxes(s, d, 0), boxes(s, d, 6), 0.1),
    "point_in_cell": lambda s, d: P.points_in_cells(points(s, d), unit_cells(s), 0.25),
    "slice_segments": lambda s, d: S.slice_segments(triangles(s, d), 0.01).select("fid", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("p_x", "p_y", "q_x", "q_y")]),
    "clip_area": clip_area,
    "keep_cells": keep,
    "refine_two_levels": refine_two_levels,
    "deform_n_steps": deform_steps,
}

_E = [f"embedding[{i + 1}]::DOUBLE" for i in range(16)]
_PTS = "p AS (SELECT vec_id AS id, " + ", ".join(f"{_E[i]} * {SCALE} AS {c}" for i, c in enumerate("xyz")) + " FROM embeddings)"
_TRI = "t0 AS (SELECT vec_id AS fid, " + ", ".join(f"{_E[3 * k + i]} AS {p}{c}" for k, p in enumerate("abc") for i, c in enumerate("xyz")) + " FROM embeddings), t1 AS (SELECT fid, ax, ay, az, bx, by_, bz, CASE WHEN fid % 10 = 0 THEN bx ELSE cx END AS cx, CASE WHEN fid % 10 = 0 THEN by_ ELSE cy END AS cy, CASE WHEN fid % 10 = 0 THEN bz ELSE cz END AS cz FROM (SELECT * RENAME (by AS by_) FROM t0))"
_TRI = _TRI.replace(" AS by,", ' AS "by",').replace("(by AS by_)", '("by" AS by_)')
_M = """t AS (SELECT *, sqrt((bx-ax)**2+(by_-ay)**2+(bz-az)**2) AS ab, sqrt((cx-bx)**2+(cy-by_)**2+(cz-bz)**2) AS bc, sqrt((ax-cx)**2+(ay-cy)**2+(az-cz)**2) AS ca,
  (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS nz FROM t1),
m AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) / 2 AS area FROM t),
an AS (SELECT *, CASE WHEN area > 0 THEN greatest(ab, bc, ca)**2 / (2 * area) END AS aspect,
  CASE WHEN area > 0 THEN degrees(least(acos(greatest(-1, least(1, (ab*ab+ca*ca-bc*bc)/(2*ab*ca)))), acos(greatest(-1, least(1, (ab*ab+bc*bc-ca*ca)/(2*ab*bc)))), acos(greatest(-1, least(1, (ca*ca+bc*bc-ab*ab)/(2*ca*bc)))))) END AS least_angle FROM m)"""


def _boxes(first: int, name: str) -> str:
    parts = ", ".join(f"{_E[first + i]} - abs({_E[first + 3 + i]}) / 4 AS lo_{c}, {_E[first + i]} + abs({_E[first + 3 + i]}) / 4 AS hi_{c}" for i, c in enumerate("xyz"))
    return f"{name} AS (SELECT vec_id AS id, {parts} FROM embeddings)"


_OUT = "sqrt(greatest(abs(x) - 0.5, 0)**2 + greatest(abs(y) - 0.5, 0)**2 + greatest(abs(z) - 0.5, 0)**2)"
#: Distance to the surface of the cube, from both sides.
_CUBE = f"CASE WHEN greatest(abs(x), abs(y), abs(z)) >= 0.5 THEN {_OUT} ELSE 0.5 - greatest(abs(x), abs(y), abs(z)) END"
#: Where a ray meets the cube: entry and exit of the three slabs.
_SLAB = ", ".join(f"least((-0.5 - {c}) / d{c}, (0.5 - {c}) / d{c}) AS n{c}, greatest((-0.5 - {c}) / d{c}, (0.5 - {c}) / d{c}) AS f{c}" for c in "xyz")
_FACES = "f(fid, a, b, c) AS (VALUES " + ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(CUBE_FACES)) + "), e AS (SELECT fid, a AS s, b AS t FROM f UNION ALL SELECT fid, b, c FROM f UNION ALL SELECT fid, c, a FROM f)"

SQL = {
    "bbox_points": f"WITH {_PTS}, b AS (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in "xyz") + " FROM p) SELECT " + ", ".join(f"round(lo_{c}, 6) AS lo_{c}, round(hi_{c}, 6) AS hi_{c}" for c in "xyz") + ", round(greatest(hi_x - lo_x, hi_y - lo_y, hi_z - lo_z), 6) AS size FROM b",
    "tri_shapes": f"WITH {_TRI}, {_M} SELECT fid, round(area, 6) AS area, round(aspect, 3) AS aspect, round(least(ab, bc, ca), 6) AS least_edge, round(greatest(ab, bc, ca), 6) AS most_edge, round(least_angle, 4) AS least_angle FROM an",
    "degenerate": f"WITH {_TRI}, {_M} SELECT fid FROM an WHERE area = 0",
    "small_area": f"WITH {_TRI}, {_M} SELECT fid FROM an WHERE area <= 0.005",
    "mesh_warnings": f"WITH {_TRI}, {_M} SELECT 'degenerate' AS kind, fid FROM an WHERE area = 0 UNION ALL SELECT 'anisotropic', fid FROM an WHERE aspect > 15",
    "cube_summary": f"WITH {_FACES} SELECT (SELECT count(DISTINCT s) FROM e) AS n_vertices, (SELECT count(DISTINCT (least(s, t), greatest(s, t))) FROM e) AS n_edges, (SELECT count(*) FROM f) AS n_faces, true AS closed, NOT EXISTS (SELECT s, t FROM e GROUP BY s, t HAVING count(*) > 1) AS consistent",
    "cube_orientation": "SELECT 1.0::DOUBLE AS volume, true AS outward",
    "cube_dihedral": "SELECT fid, round(pi() / 2, 6) AS dihedral FROM range(12) t(fid)",
    "cube_neighbors": f"WITH {_FACES} SELECT g.fid::BIGINT AS fid, h.fid::BIGINT AS nbr FROM e g JOIN e h ON g.s = h.t AND g.t = h.s",
    "circle_fit": """WITH q AS (SELECT 2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440.0::DOUBLE AS th, 10.0 + (event_id % 7) / 70.0::DOUBLE AS r FROM events), c AS (SELECT 3 + r * cos(th) AS x, -2 + r * sin(th) AS y FROM q),
      m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my FROM c), u AS (SELECT x - mx AS u, y - my AS v, m.* FROM c, m),
      s AS (SELECT any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, sum(u*u) AS uu, sum(u*v) AS uv, sum(v*v) AS vv, sum(u*(u*u+v*v)) / 2 AS a, sum(v*(u*u+v*v)) / 2 AS b FROM u),
      k AS (SELECT *, (a*vv - b*uv) / (uu*vv - uv*uv) AS cu, (uu*b - uv*a) / (uu*vv - uv*uv) AS cv FROM s)
      SELECT round(cu + mx, 6) AS cx, round(cv + my, 6) AS cy, round(sqrt(cu*cu + cv*cv + (uu + vv) / n), 6) AS r, n FROM k""",
    "extrusion_samples": f"WITH {_PTS} SELECT 1 AS inflow, round(greatest(0, -min(z)), 6) AS depth FROM p UNION ALL SELECT 2, round(greatest(0, -min(0.5 - x)), 6) FROM p UNION ALL SELECT 3, round(greatest(0, -min((27 - x - y - z) / sqrt(3))), 6) FROM p",
    "nearest_point": f"WITH {_PTS} SELECT id, round({_CUBE}, 6) + 0.0 AS distance FROM p",
    "sphere_hits": f"WITH {_PTS} SELECT id, ({_CUBE}) <= 0.1 + (id % 5) / 10.0::DOUBLE AS hit FROM p",
    "inside_parity": f"WITH {_PTS} SELECT id, greatest(abs(x), abs(y), abs(z)) < 0.5 AS inside FROM p",
    "ray_first_hit": f"WITH {_PTS}, d AS (SELECT p.*, {', '.join(f'{_E[10 + i]} AS d{c}' for i, c in enumerate('xyz'))} FROM p JOIN embeddings ON vec_id = id), s AS (SELECT *, {_SLAB} FROM d), h AS (SELECT id, greatest(nx, ny, nz) AS near, least(fx, fy, fz) AS far FROM s) SELECT id, CASE WHEN near > far OR far < 0 THEN NULL ELSE round(CASE WHEN near >= 0 THEN near ELSE far END, 6) END AS distance FROM h",
    "aabb_overlap_join": f"WITH {_boxes(0, 'l')}, {_boxes(6, 'r')} SELECT l.id AS a, r.id AS b FROM l JOIN r ON " + " AND ".join(f"l.lo_{c} <= r.hi_{c} AND r.lo_{c} <= l.hi_{c}" for c in "xyz"),
    "point_in_cell": f"WITH {_PTS}, c AS (SELECT i AS id, (i % 4) * 0.25 - 0.5 AS lx, (i // 4 % 4) * 0.25 - 0.5 AS ly, (i // 16) * 0.25 - 0.5 AS lz FROM range(64) t(i)) SELECT p.id AS a, c.id AS b FROM p JOIN c ON x BETWEEN lx AND lx + 0.25 AND y BETWEEN ly AND ly + 0.25 AND z BETWEEN lz AND lz + 0.25",
    # a row of cells, each cut into nine along every side
    "refine_two_levels": "WITH d AS (SELECT 9 * (count(*) // 8 + 1) AS n FROM supplier) SELECT ((n + 1) * 10 * 10)::BIGINT AS n_nodes, (n * 9 * 9)::BIGINT AS n_cells, 2::BIGINT AS most_owners, ((n + 1) * 9 * 9 + 2 * n * 10 * 9)::BIGINT AS n_faces FROM d",
    "clip_area": "SELECT 6.0::DOUBLE AS area",
}
