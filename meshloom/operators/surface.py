"""Analysis of triangle surfaces: defects, orientation, gaps.

A surface is sv (vid, x, y, z) and sf (fid, v array<long>). `corners` joins them once; the rest are projections and joins on
face ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions import vectors as V
from meshloom.operators import topology as T
from meshloom.operators.histogram import argmin_with_fallback

SMALL_AREA, SHORT_NORMAL, MOST_ASPECT = 1e-20, 1e-8, 15.0
NEIGHBOR_RATIO, NORMAL_ANGLE, SMALL_ANGLE = 2.0, 60.0, 0.5
SEARCH_RADIUS, GAP_ASPECT, GAP_EDGE_RATIO, GAP_SIZE, DIHEDRAL = 0.005, 10.0, 10.0, 1e-4, 0.3


def corners(sv: DataFrame, sf: DataFrame) -> DataFrame:
    """(fid, v, a_x .. c_z): the corners of each face as nine columns."""
    at = sf.select("fid", "v", F.posexplode("v").alias("pos", "vid")).join(sv.select("vid", "x", "y", "z"), "vid")
    p = at.groupBy("fid").agg(F.first("v").alias("v"), F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))).alias("p"))
    return p.select("fid", "v", *[F.col("p")[i][c].alias(f"{n}_{c}") for i, n in enumerate("abc") for c in "xyz"])


def abc() -> tuple[V.Vector, V.Vector, V.Vector]:
    return V.vec("a"), V.vec("b"), V.vec("c")


def measures(faces: DataFrame) -> DataFrame:
    """faces with area, aspect, normal (n_x ..), centroid (m_x ..), edges and interior angles."""
    a, b, c = abc()
    n, m = V.unit(V.triangle_normal(a, b, c)), V.mean([a, b, c])
    edges, angles = V.edge_lengths(a, b, c), V.interior_angles(a, b, c)
    named = {f"n_{k}": x for k, x in zip("xyz", n, strict=True)} | {f"m_{k}": x for k, x in zip("xyz", m, strict=True)}
    named |= {"area": V.triangle_area(a, b, c), "aspect": V.aspect_ratio(a, b, c), "least_edge": F.least(*edges), "most_edge": F.greatest(*edges), "least_angle": F.when(V.triangle_area(a, b, c) > 0, F.least(*angles))}
    return faces.withColumns(named)


def mesh_size(sv: DataFrame) -> DataFrame:
    """(lo_x .. hi_z, size): the bounding box and its longest extent."""
    box = sv.agg(*[F.min(c).alias(f"lo_{c}") for c in "xyz"], *[F.max(c).alias(f"hi_{c}") for c in "xyz"])
    return box.withColumn("size", F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"]))


def degenerate() -> Column:
    """Collinear or repeated corners, or one that isn't finite."""
    a, b, c = abc()
    bad = F.lit(False)
    for x in (*a, *b, *c):
        bad = bad | F.isnan(x) | (F.abs(x) == float("inf"))
    return bad | (V.norm(V.triangle_normal(a, b, c)) == 0)


def small_area(size: float, relative: float = SMALL_AREA) -> Column:
    return F.abs(V.triangle_area(*abc())) <= size * size * relative


def warnings(faces: DataFrame) -> DataFrame:
    """(kind, fid) of degenerate and of anisotropic faces."""
    rows = measures(faces)
    kinds = F.array_compact(F.array(F.when(degenerate(), F.lit("degenerate")), F.when(F.col("aspect") > MOST_ASPECT, F.lit("anisotropic"))))
    return rows.select(F.explode(kinds).alias("kind"), "fid")


def vertex_normals(faces: DataFrame) -> DataFrame:
    """(vid, n_x, n_y, n_z): unit sums of face normals, weighted by the angle at the vertex."""
    a, b, c = abc()
    n, angles = V.unit(V.triangle_normal(a, b, c)), V.interior_angles(a, b, c)
    parts = F.array(*[F.struct(F.col("v")[i].alias("vid"), *[(x * F.coalesce(w, F.lit(0.0))).alias(k) for x, k in zip(n, "xyz", strict=True)]) for i, w in enumerate(angles)])
    sums = faces.select(F.inline(parts)).groupBy("vid").agg(*[F.sum(k).alias(k) for k in "xyz"])
    return sums.select("vid", *[x.alias(f"n_{k}") for x, k in zip(V.unit((F.col("x"), F.col("y"), F.col("z"))), "xyz", strict=True)])


def centroid_normals(faces: DataFrame) -> DataFrame:
    """(fid, n_x, n_y, n_z, length): the mean of the corners' vertex normals."""
    at = faces.select("fid", F.explode("v").alias("vid")).join(vertex_normals(faces), "vid")
    means = at.groupBy("fid").agg(*[F.avg(f"n_{k}").alias(f"n_{k}") for k in "xyz"])
    return means.withColumn("length", V.norm(V.vec("n")))


def usable(faces: DataFrame, size: float) -> DataFrame:
    """faces without those of small area or short centroid normal."""
    short = centroid_normals(faces).where(F.col("length") <= SHORT_NORMAL).select("fid")
    small = faces.where(small_area(size)).select("fid")
    return faces.join(short.union(small).distinct(), "fid", "left_anti")


def dihedral(faces: DataFrame) -> DataFrame:
    """(fid, dihedral): the largest angle, in radians, to the normal of a face that shares a vertex; cosines are held in 0..1."""
    n = measures(faces).select("fid", "n_x", "n_y", "n_z")
    near = T.vertex_neighbors(faces.select("fid", "v"))
    both = near.join(n, "fid").join(n.toDF("nbr", "o_x", "o_y", "o_z"), "nbr")
    cosine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), V.dot(V.vec("n"), V.vec("o"))))
    return both.groupBy("fid").agg(F.max(F.acos(cosine)).alias("dihedral"))


def orientation(faces: DataFrame) -> DataFrame:
    """(volume, outward): the signed volume of a closed surface."""
    a, b, c = abc()
    return faces.agg(F.sum(V.dot(a, V.cross(b, c)) / 6).alias("volume")).withColumn("outward", F.col("volume") > 0)


def axis_distances(faces: DataFrame, center=(0.0, 0.0)) -> DataFrame:
    """(most, least): the largest distance of a vertex from an axis along z, and the smallest of a triangle."""
    flat = [tuple(p[:2]) + (F.lit(0.0),) for p in abc()]
    q = V.lits(center[0], center[1], 0.0)
    near = F.sqrt(V.point_triangle_distance2(q, *flat))
    return faces.agg(F.max(F.greatest(*[V.radial(p, center) for p in flat])).alias("most"), F.min(near).alias("least"))


def circle_fit(points: DataFrame) -> DataFrame:
    """(cx, cy, r, n): the least-squares circle of points (x, y), from sums alone."""
    sums = points.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(e).alias(k) for k, e in {"sx": F.col("x"), "sy": F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y")}.items()],
        F.sum(F.col("x") * (F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("xz"),
        F.sum(F.col("y") * (F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("yz"),
    )
    n = F.col("n")
    a, b, c = F.col("xx") - F.col("sx") * F.col("sx") / n, F.col("xy") - F.col("sx") * F.col("sy") / n, F.col("yy") - F.col("sy") * F.col("sy") / n
    z = F.col("xx") + F.col("yy")
    d, e = (F.col("xz") - F.col("sx") * z / n) / 2, (F.col("yz") - F.col("sy") * z / n) / 2
    det = a * c - b * b
    cx, cy = (d * c - b * e) / det, (a * e - b * d) / det
    out = sums.where(det != 0).withColumn("cx", cx).withColumn("cy", cy)
    mx, my = F.col("sx") / n, F.col("sy") / n
    r2 = z / n - 2 * F.col("cx") * mx - 2 * F.col("cy") * my + F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy")
    return out.select("cx", "cy", F.sqrt(r2).alias("r"), "n")


def slice_segments(faces: DataFrame, z: float) -> DataFrame:
    """(fid, p_x, p_y, q_x, q_y): where triangles cross the plane at height z."""
    ends = []
    for p, q in ((V.vec("a"), V.vec("b")), (V.vec("b"), V.vec("c")), (V.vec("c"), V.vec("a"))):
        t = (z - p[2]) / (q[2] - p[2])
        ends.append(F.when((p[2] < z) != (q[2] < z), F.struct((p[0] + t * (q[0] - p[0])).alias("x"), (p[1] + t * (q[1] - p[1])).alias("y"))))
    rows = faces.select("fid", F.array_compact(F.array(*ends)).alias("e")).where(F.size("e") == 2)
    return rows.select("fid", *[F.col("e")[i][c].alias(f"{n}_{c}") for i, n in enumerate("pq") for c in "xy"])


def extrusions(sv: DataFrame, inflows: list[tuple[int, tuple, tuple]]) -> DataFrame:
    """(inflow, depth): how far the surface reaches behind each inflow (id, center, normal), 0 at least."""
    parts = [F.greatest(F.lit(0.0), -F.min(V.dot(V.sub((F.col("x"), F.col("y"), F.col("z")), V.lits(*c)), V.unit(V.lits(*n))))).alias(f"d{i}") for i, c, n in inflows]
    row = sv.agg(*parts)
    return row.select(F.inline(F.array(*[F.struct(F.lit(i).alias("inflow"), F.col(f"d{i}").alias("depth")) for i, _, _ in inflows])))


def small_angle_validity(faces: DataFrame, limit: float = SMALL_ANGLE) -> DataFrame:
    """(fid, validity): 4 where an interior angle is below the limit."""
    return measures(faces).select("fid", F.when(F.col("least_angle") < limit, 4).otherwise(0).alias("validity"))


def validity(faces: DataFrame, diameters: DataFrame) -> DataFrame:
    """(fid, validity): 2 if all three neighbours exist and are over twice as wide, else 3 if a neighbour's normal is over 60
    degrees off, else 4 for a small angle, else 0."""
    near = T.triangle_neighbors(faces.select("fid", "v"))
    n = measures(faces).select("fid", "n_x", "n_y", "n_z", "least_angle").join(diameters.select("fid", F.col("diameter").alias("d")), "fid")
    other = n.select(F.col("fid").alias("nbr"), *[F.col(f"n_{k}").alias(f"o_{k}") for k in "xyz"], F.col("d").alias("od"))
    pairs = near.join(n, "fid").join(other, "nbr")
    off = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(V.vec("n"), V.vec("o"))))))
    seen = pairs.groupBy("fid").agg(F.count(F.lit(1)).alias("k"), F.min("od").alias("od"), F.max(off).alias("off"))
    rows = n.join(seen, "fid", "left")
    wide = (F.col("d") > 0) & (F.col("k") >= 3) & (F.col("od") > NEIGHBOR_RATIO * F.col("d"))
    return rows.select("fid", F.when(wide, 2).when(F.col("off") > NORMAL_ANGLE, 3).when(F.col("least_angle") < SMALL_ANGLE, 4).otherwise(0).alias("validity"))


def topo_score(distance: Column, diameter: Column, radius: Column) -> Column:
    """0 for touching faces, 1 for unreachable ones (-1) and from half the sphere's girth on, growing with the square before that."""
    girth = F.lit(math.pi / 2) * diameter
    near = (girth < radius) & (distance < girth)
    return F.when(distance == 0, 0.0).when(distance == -1, 1.0).when(near, (distance / girth) * (distance / girth)).otherwise(1.0)


def normal_score(similarity: Column) -> Column:
    """1 for opposite normals, 0 for those that agree."""
    return F.when(similarity < 0, F.pow(-similarity, F.lit(1.0 / 3.0))).otherwise(0.0)


def dihedral_score(angle: Column, limit: float = DIHEDRAL) -> Column:
    """1 for flat surroundings, falling with the angle beyond the limit."""
    return F.when(angle < limit, 1.0).otherwise(F.sqrt(1.0 - (angle + limit) / math.pi))


def gap_scores(faces: DataFrame, records: DataFrame, crossings: DataFrame, size: float) -> DataFrame:
    """(fid, opposite, diameter, score) of gap records (fid, opposite, diameter, similarity, topo, back, dihedral).

    back is the topological distance that the opposite face has. Scores are 0 for stretched faces, sizes that are tiny or differ
    too much, and pairs that cross each other (a, b).
    """
    shape = measures(faces).select("fid", "aspect", "most_edge")
    rows = records.join(shape, "fid").join(shape.select(F.col("fid").alias("opposite"), F.col("aspect").alias("oa"), F.col("most_edge").alias("oe")), "opposite", "left")
    crossed = crossings.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct().withColumn("x", F.lit(True))
    rows = rows.withColumns({"p": F.least("fid", "opposite"), "q": F.greatest("fid", "opposite")}).join(crossed, ["p", "q"], "left")
    ratio = F.greatest("most_edge", "oe") / F.least("most_edge", "oe")
    good = (F.col("aspect") < GAP_ASPECT) & (F.col("oa") < GAP_ASPECT) & F.col("x").isNull() & (F.col("diameter") / size > GAP_SIZE) & (ratio < GAP_EDGE_RATIO)
    radius = F.greatest(math.pi * F.col("diameter"), F.lit(SEARCH_RADIUS * size))
    both = (F.col("topo") == -1) & (F.col("back") == -1)
    pieces = topo_score(F.col("topo"), F.col("diameter"), radius) + normal_score(F.col("similarity")) + dihedral_score(F.col("dihedral"))
    score = F.when(F.coalesce(good, F.lit(False)), F.when(both, 1.0).otherwise(pieces / 3)).otherwise(0.0)
    return rows.select("fid", "opposite", "diameter", score.alias("score"))


def min_gap(scores: DataFrame) -> DataFrame:
    """The gap of the least diameter among the best-scored ones, ties to the lowest face."""
    return argmin_with_fallback(scores.select("fid", "diameter", "score"), "score", "diameter", ["fid"])


def invalidate_below(faces: DataFrame, gap: float) -> DataFrame:
    """monitor -1 and validity 5 where the monitor lies below the gap; other validities stay."""
    low = F.col("monitor") < gap
    return faces.withColumns({"validity": F.when(low & (F.col("validity") == 0), 5).otherwise(F.col("validity")), "monitor": F.when(low, -1.0).otherwise(F.col("monitor"))})


def bin_components(faces: DataFrame, bins: DataFrame, areas: DataFrame, share: float = 1e-4) -> DataFrame:
    """(bin, connected, isolated, largest): components of the faces (fid, bin) of each bin, split by their share of all area."""
    near = T.triangle_neighbors(faces.select("fid", "v"))
    tag = bins.select("fid", "bin")
    links = near.join(tag, "fid").join(tag.toDF("nbr", "obin"), "nbr").where("bin = obin").select(F.col("fid").alias("a"), F.col("nbr").alias("b"))
    comp = T.components(tag.select(F.col("fid").alias("id")), links)
    sizes = comp.join(tag.withColumnRenamed("fid", "id"), "id").join(areas.select(F.col("fid").alias("id"), "area"), "id").groupBy("bin", "component").agg(F.sum("area").alias("area"))
    all_ = F.sum("area").over(Window.partitionBy(F.lit(1)))  # a row for each component
    rows = sizes.withColumn("big", F.col("area") >= share * all_)
    return rows.groupBy("bin").agg(F.sum(F.col("big").cast("long")).alias("connected"), F.sum((~F.col("big")).cast("long")).alias("isolated"), F.max("area").alias("largest"))
