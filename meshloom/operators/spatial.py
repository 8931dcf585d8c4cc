"""Spatial joins.

Boxes meet by a grid: each box goes to the cells it touches, cells join by key, and a pair is kept in the one cell that holds the
greater of the lower corners, so no distinct is needed. Distances, rays, segments and insideness are such joins as well, on grids of
several levels, so that neither large triangles nor far points fill many cells; what is left is computed by column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions import kernels as K
from meshloom.functions import predicates as X
from meshloom.functions import vectors as V
from meshloom.operators.hierarchy import Hierarchy, first_hits, hierarchy, nearest, segments_hit  # noqa: F401
from meshloom.sources.shared import written

#: A sphere that shrinks by less is done; rounds end with the last sphere, a few tens on usual surfaces, or after so many.
TOLERANCE, ROUNDS = 1e-6, 200


def _grid(boxes: DataFrame, size: float, name: str) -> DataFrame:
    """A row for each grid cell that a box touches."""
    rows = boxes
    for c in "xyz":
        lo, hi = F.floor(F.col(f"lo_{c}") / size), F.floor(F.col(f"hi_{c}") / size)
        rows = rows.withColumn(f"_{c}", F.explode(F.sequence(lo, hi)))
    return rows.withColumnsRenamed({k: f"{name}_{k}" for k in boxes.columns})


def overlap_join(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """(a, b): ids of boxes (id, lo_x .. hi_z) of both sides that overlap, touching included. size: edge of the grid's cells."""
    a, b = _grid(left, size, "l"), _grid(right, size, "r")
    met = a.join(b, ["_x", "_y", "_z"])
    apart = reduce(lambda p, q: p & q, [(F.col(f"l_lo_{c}") <= F.col(f"r_hi_{c}")) & (F.col(f"r_lo_{c}") <= F.col(f"l_hi_{c}")) for c in "xyz"])
    own = reduce(lambda p, q: p & q, [F.col(f"_{c}") == F.floor(F.greatest(f"l_lo_{c}", f"r_lo_{c}") / size) for c in "xyz"])
    return met.where(apart & own).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


def points_in_cells(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """(a, b): points (id, x, y, z) and closed boxes; points on a common side belong to both."""
    boxes = points.select("id", *[F.col(c).alias(f"lo_{c}") for c in "xyz"], *[F.col(c).alias(f"hi_{c}") for c in "xyz"])
    return overlap_join(boxes, cells, size)


def triangle_boxes(faces: DataFrame) -> DataFrame:
    """(id, lo_x .. hi_z) of faces with corners a, b, c."""
    lo, hi = V.bounds([V.vec("a"), V.vec("b"), V.vec("c")])
    return faces.select(F.col("fid").alias("id"), *[x.alias(f"{s}_{c}") for s, v in (("lo", lo), ("hi", hi)) for x, c in zip(v, "xyz", strict=True)])


def crossings(faces: DataFrame) -> DataFrame:
    """(a, b, shared), a < b: pairs of triangles (fid, v, a_x .. c_z) that meet in more than the corners and sides they share.

    shared is the number of common corners. Triangles whose boxes touch are tested by exact predicates; ones without an area, or with
    a corner that isn't finite, meet nothing.
    """
    bounds = surface_bounds(faces)
    columns = [f"{n}_{c}" for n in "abc" for c in "xyz"]
    if bounds is None:
        return faces.sparkSession.createDataFrame([], "a long, b long, shared int")
    sound = reduce(lambda p, q: p & q, [F.abs(F.col(c)) < float("inf") for c in columns])
    boxes = _with_boxes(faces.where(sound)).join(faces.select("fid", "v"), "fid")
    met = level_join(boxes, boxes, _unit(bounds)).where("l_fid < r_fid")
    sides = [f"{s}_{c}" for s in "lr" for c in columns]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            p, q = (np.stack([part.column(f"{s}_{c}").to_numpy() for c in columns], axis=1).reshape(-1, 3, 3) for s in "lr")
            vp, vq = (part.column(f"{s}_v").flatten().to_numpy().reshape(-1, 3) for s in "lr")
            hit, shared = X.triangles_cross(p, q, vp, vq)
            rows = pa.RecordBatch.from_arrays([part.column("l_fid"), part.column("r_fid"), pa.array(shared, pa.int32())], names=["a", "b", "shared"])
            yield rows.filter(pa.array(hit))

    flat = met.select(F.col("l_fid").cast("long").alias("l_fid"), F.col("r_fid").cast("long").alias("r_fid"), *[F.col(f"{s}_v").cast("array<long>").alias(f"{s}_v") for s in "lr"], *[F.col(c).cast("double").alias(c) for c in sides])
    return flat.mapInArrow(run, "a long, b long, shared int")


def surface_bounds(faces: DataFrame) -> dict[str, float] | None:
    """lo_x .. hi_z of a surface and the mean extent of its triangles; None if it has none."""
    boxes = triangle_boxes(faces)
    row = boxes.agg(*[F.min(f"lo_{c}").alias(f"lo_{c}") for c in "xyz"], *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in "xyz"], F.avg(_extent("lo", "hi")).alias("mean")).first()
    return None if row["mean"] is None else row.asDict()


def _extent(lo: str, hi: str) -> Column:
    return F.greatest(*[F.col(f"{hi}_{c}") - F.col(f"{lo}_{c}") for c in "xyz"])


def level_join(left: DataFrame, right: DataFrame, unit: float) -> DataFrame:
    """Pairs of rows (l_.., r_..) whose boxes lo_x .. hi_z overlap, for boxes of very different sizes.

    A box of extent up to unit * 2^k is of level k and touches eight cells of that level's grid at most. Each box also goes to the
    grids of the higher levels that the other side has, so that a pair meets at the greater of its two levels, and is kept in the one
    cell there that holds the greater of the lower corners. unit should be near the usual extent of the smaller boxes.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(_extent("lo", "hi") / unit, F.lit(1.0))))).cast("int")
    left, right = left.withColumn("_own", level), right.withColumn("_own", level)
    seen = [sorted(df.agg(F.collect_set("_own")).first()[0]) for df in (left, right)]  # levels are logarithms: tens at most

    def dealt(df: DataFrame, others: list[int], name: str) -> DataFrame:
        higher = F.filter(F.array(*[F.lit(k) for k in others]).cast("array<int>"), lambda k: k > F.col("_own"))
        rows = df.withColumn("_level", F.explode(F.concat(F.array("_own"), higher)))
        size = unit * F.pow(F.lit(2.0), F.col("_level"))
        for c in "xyz":
            rows = rows.withColumn(f"_{c}", F.explode(F.sequence(F.floor(F.col(f"lo_{c}") / size), F.floor(F.col(f"hi_{c}") / size))))
        return rows.withColumnsRenamed({k: f"{name}_{k}" for k in df.columns})

    met = dealt(left, seen[1], "l").join(dealt(right, seen[0], "r"), ["_level", "_x", "_y", "_z"])
    size = unit * F.pow(F.lit(2.0), F.col("_level"))
    meet = [(F.col(f"l_lo_{c}") <= F.col(f"r_hi_{c}")) & (F.col(f"r_lo_{c}") <= F.col(f"l_hi_{c}")) & (F.col(f"_{c}") == F.floor(F.greatest(f"l_lo_{c}", f"r_lo_{c}") / size)) for c in "xyz"]
    return met.where(reduce(lambda p, q: p & q, meet, F.col("_level") == F.greatest("l__own", "r__own")))


def _flat(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"lo_z": F.lit(0.0), "hi_z": F.lit(0.0)})


def _with_boxes(faces: DataFrame) -> DataFrame:
    """Faces (fid, a_x .. c_z) with their boxes."""
    lo, hi = V.bounds([V.vec("a"), V.vec("b"), V.vec("c")])
    named = {f"{s}_{c}": x for s, v in (("lo", lo), ("hi", hi)) for x, c in zip(v, "xyz", strict=True)}
    return faces.select("fid", *[f"{p}_{c}" for p in "abc" for c in "xyz"]).withColumns(named)


def _unit(bounds: dict[str, float]) -> float:
    """A cell's size for a surface: its triangles' mean extent, but a millionth of all at least."""
    whole = max(bounds[f"hi_{c}"] - bounds[f"lo_{c}"] for c in "xyz")
    return max(bounds["mean"], whole * 1e-6) or 1.0


def nearest_point_of(groups: DataFrame, faces: DataFrame) -> DataFrame:
    """(group, id): of the points (group, id, x, y, z) of each group, the one nearest to the surface."""
    near = nearest(groups.select("id", "x", "y", "z"), faces)
    return groups.join(near, "id").groupBy("group").agg(F.min(F.struct("distance", "id")).alias("m")).select("group", F.col("m.id").alias("id"))


def sphere_hits(spheres: DataFrame, faces: DataFrame) -> DataFrame:
    """(id, hit): whether spheres (id, x, y, z, r) meet the surface."""
    return spheres.join(nearest(spheres, faces), "id", "left").select("id", F.coalesce(F.col("distance") * F.col("distance") <= F.col("r") * F.col("r"), F.lit(False)).alias("hit"))


def inside(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(id, inside): whether the closed surface winds around each point.

    The triangles above a point are counted with the sign of their turn in the plane. Sides are told by their lower end first, so two
    triangles agree on their common side, and each point lies in one of them.
    """
    bounds = surface_bounds(faces)
    if bounds is None:
        return points.select("id", F.lit(False).alias("inside"))
    spots = _flat(points.select("id", "x", "y", "z").dropna().withColumns({f"{s}_{c}": F.col(c) for s in ("lo", "hi") for c in "xy"}))
    sides = _with_boxes(faces).withColumn("top", F.col("hi_z"))
    met = level_join(spots, _flat(sides), _unit(bounds)).where("r_top >= l_z")
    px, py = F.col("l_x"), F.col("l_y")
    a, b, c = (V.vec(f"r_{p}") for p in "abc")

    def turn(s: V.Vector, e: V.Vector) -> Column:
        def left_of(low: V.Vector, high: V.Vector) -> Column:
            return (high[0] - low[0]) * (py - low[1]) - (px - low[0]) * (high[1] - low[1]) > 0

        return F.when((s[1] <= py) & (e[1] > py) & left_of(s, e), 1).when((s[1] > py) & (e[1] <= py) & left_of(e, s), -1).otherwise(0)

    n = V.triangle_normal(a, b, c)
    above = (V.dot(n, V.sub(a, V.vec("l"))) > 0) == (n[2] > 0)
    wound = met.groupBy(F.col("l_id").alias("id")).agg(F.sum(F.when(above, turn(a, b) + turn(b, c) + turn(c, a)).otherwise(0)).alias("w"))
    return points.select("id").join(wound, "id", "left").select("id", (F.coalesce("w", F.lit(0)) != 0).alias("inside"))


def signed_distances(points: DataFrame, faces: DataFrame) -> DataFrame:
    """(id, distance): positive inside."""
    return nearest(points, faces).join(inside(points, faces), "id").select("id", F.when(F.col("inside"), F.col("distance")).otherwise(-F.col("distance")).alias("distance"))


def inscribed(faces: DataFrame) -> DataFrame:
    """(fid, diameter, opposite): the spheres inside that touch the surface at the middles of its triangles.

    A sphere starts with half the way to what the inward ray meets first, but half the least extent of the surface at most, and that
    if it meets nothing; opposite is then null. In rounds, spheres whose centres have a nearer point of the surface shrink to pass
    through it, all at once: a search for the nearest within the radius, as the touching point is that far away. A sphere is done
    when the nearest point is its own triangle's or behind it, lies no deeper in the sphere than the bend of a triangle of its size
    explains, or took less than TOLERANCE off its radius. Each round is written; of ROUNDS, the last leaves spheres as they are.
    """
    tree = hierarchy(faces)
    if tree is None:
        return faces.select(F.col("fid").cast("long").alias("fid"), F.lit(0.0).alias("diameter"), F.lit(None).cast("long").alias("opposite"))
    a, b, c = V.vec("a"), V.vec("b"), V.vec("c")
    bounds = surface_bounds(faces)
    most = min(bounds[f"hi_{k}"] - bounds[f"lo_{k}"] for k in "xyz") / 2
    outward = tree.faces.agg(F.sum(V.dot(a, V.cross(b, c)))).first()[0] > 0
    normal = V.scale(V.unit(V.triangle_normal(a, b, c)), -1.0 if outward else 1.0)
    start = tree.faces.select(F.col("fid").cast("long").alias("id"), *[x.alias(k) for x, k in zip(V.mean([a, b, c]), "xyz", strict=True)], *[x.alias(f"d{k}") for x, k in zip(normal, "xyz", strict=True)], F.greatest(*V.edge_lengths(a, b, c)).alias("edge"))
    start = written(start, "starts")
    hits = first_hits(start.withColumn("own", F.col("id")), tree)
    live = start.join(hits, "id").select(*start.columns, F.least(F.lit(most), F.coalesce(F.col("distance") / 2, F.lit(most))).alias("r"), F.col("fid").alias("opposite"))
    live, done = written(live, "spheres"), []
    own, d = tuple(F.col(k) for k in "xyz"), tuple(F.col(f"d{k}") for k in "xyz")
    corners = tree.faces.select("fid", *[f"{p}_{k}" for p in "abc" for k in "xyz"])
    for _ in range(ROUNDS):
        centers = live.select("id", *[(p + F.col("r") * n).alias(k) for p, n, k in zip(own, d, "xyz", strict=True)], "r")
        near = nearest(centers, tree, F.col("r") * (1 + 1e-9) + TOLERANCE).select("id", "distance", "fid")
        met = live.join(near, "id").join(corners, "fid", "left")
        middle = tuple(p + F.col("r") * n for p, n in zip(own, d, strict=True))
        met = met.withColumns({f"q{k}": x for x, k in zip(V.closest_on_triangle(middle, a, b, c), "xyz", strict=True)})
        way = V.sub(tuple(F.col(f"q{k}") for k in "xyz"), own)
        along, length = V.dot(way, d), V.dot(way, way)
        half = F.col("edge") / 2
        bend = F.when(F.col("edge") < 1.5 * F.col("r"), F.col("r") - F.sqrt(F.col("r") * F.col("r") - half * half)).otherwise(0.02 * F.col("r"))
        stays = F.coalesce((F.col("fid") == F.col("id")) | (along <= 0) | (F.col("distance") >= F.col("r") - 2 * bend), F.lit(True))
        off = V.cross(way, d)
        smaller = F.when(V.dot(off, off) == 0, F.sqrt(length)).otherwise(F.try_divide(length, 2 * along))
        found = met.withColumn("new", F.when(stays, F.col("r")).otherwise(F.least(smaller, F.col("r")))).withColumn("opposite", F.when(stays, F.col("opposite")).otherwise(F.col("fid")))
        found = written(found.select(*start.columns, "new", "opposite", (~stays & (F.col("r") - F.col("new") > TOLERANCE)).alias("goes_on")), "round")
        done.append(found.where("NOT goes_on").select("id", F.col("new").alias("r"), "opposite"))
        live = found.where("goes_on").select(*start.columns, F.col("new").alias("r"), "opposite")
        if live.isEmpty():
            break
    spheres = reduce(DataFrame.union, done, live.select("id", "r", "opposite").limit(0) if len(done) < ROUNDS else live.select("id", "r", "opposite"))
    return faces.select(F.col("fid").cast("long").alias("fid")).join(spheres.withColumnRenamed("id", "fid"), "fid", "left").select("fid", F.coalesce(2 * F.col("r"), F.lit(0.0)).alias("diameter"), "opposite")


def clip_cells(nodes_of: DataFrame, faces: DataFrame, candidates: DataFrame) -> DataFrame:
    """(cid, fid, tet, itype, area): what triangles share with the 40 tetrahedra of each candidate cell (a: cid, b: fid).

    nodes_of is (cid, p) with eight corners. Pairs that share nothing are left out.
    """
    columns = [f"{p}_{c}" for p in "abc" for c in "xyz"]
    rows = candidates.select(F.col("a").alias("cid"), F.col("b").alias("fid")).join(nodes_of, "cid").join(faces.select("fid", *columns), "fid")
    flat = rows.select("cid", "fid", F.flatten(F.transform("p", lambda q: F.array(q["x"], q["y"], q["z"]))).alias("p"), F.array(*columns).alias("t"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tets = K.hex_tetrahedra()
        for part in parts:
            out = []
            for cid, fid, p, t in zip(part["cid"], part["fid"], part["p"], part["t"], strict=True):
                points, tri = K.hex_points(np.array(p).reshape(8, 3)), np.array(t).reshape(3, 3)
                lo, hi = tri.min(0), tri.max(0)
                for k, tet in enumerate(tets):
                    corners = points[tet]
                    if (corners.max(0) >= lo).all() and (corners.min(0) <= hi).all():
                        kind, shared = K.clip_triangle(tri, corners)
                        if kind:
                            out.append((cid, fid, k, kind, K.area_of(shared)))
            yield pd.DataFrame(out, columns=["cid", "fid", "tet", "itype", "area"])

    return flat.mapInPandas(run, "cid long, fid long, tet int, itype int, area double")


def minimal_spheres(points_of: DataFrame) -> DataFrame:
    """(id, p, x, y, z, r) of cells (cid, p): the smallest sphere around their corners."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [K.minimal_sphere(np.array(p).reshape(-1, 3)) for p in part["f"]]
            yield pd.DataFrame({"id": part["cid"], **{c: [s[0][i] for s in found] for i, c in enumerate("xyz")}, "r": [s[1] for s in found]})

    flat = points_of.select("cid", F.flatten(F.transform("p", lambda q: F.array(q["x"], q["y"], q["z"]))).alias("f"))
    spheres = flat.mapInPandas(run, "id long, x double, y double, z double, r double")
    return spheres.join(points_of.select(F.col("cid").alias("id"), "p"), "id")


def keep_cells(points_of: DataFrame, faces: DataFrame) -> DataFrame:
    """(cid, outcome) of cells (cid, p): inside, intersected, edge, diagonal, center or discarded.

    Tests run from cheap to dear, each on the cells that the last left open: all or some corners inside; the cell's sphere away
    from the surface, then by its centre; an edge meets the surface; a diagonal does.
    """
    corners = points_of.select("cid", F.posexplode("p").alias("k", "q")).select((F.col("cid") * 8 + F.col("k")).alias("id"), "cid", "q.x", "q.y", "q.z")
    told = corners.join(inside(corners, faces), "id").groupBy("cid").agg(F.sum(F.col("inside").cast("int")).alias("n"))
    done = written(told.select("cid", F.when(F.col("n") == 8, "inside").when(F.col("n") > 0, "intersected").alias("outcome")), "corners")
    open_ = written(points_of.join(done.where("outcome IS NULL"), "cid", "left_semi"), "open")
    balls = written(minimal_spheres(open_), "spheres")
    near = written(balls.join(sphere_hits(balls.select("id", "x", "y", "z", "r"), faces), "id"), "balls")
    middle = inside(near.where("NOT hit").select("id", "x", "y", "z"), faces).select(F.col("id").alias("cid"), F.when(F.col("inside"), "center").otherwise("discarded").alias("outcome"))

    def lines(rows: DataFrame, pairs) -> DataFrame:
        ends = F.array(*[F.struct(F.col("p")[i].alias("s"), F.col("p")[j].alias("e")) for i, j in pairs])
        return rows.select("id", F.explode(ends).alias("l")).select("id", "l.s.x", "l.s.y", "l.s.z", F.col("l.e.x").alias("ex"), F.col("l.e.y").alias("ey"), F.col("l.e.z").alias("ez"))

    touching = near.where("hit").select("id", "p")
    by_edge = written(segments_hit(lines(touching, V.HEX_EDGES), faces), "edges")
    rest = touching.join(by_edge.where("NOT hit"), "id", "left_semi")
    by_diagonal = segments_hit(lines(rest, ((0, 6), (1, 7), (2, 4), (3, 5))), faces)
    edge = by_edge.where("hit").select(F.col("id").alias("cid"), F.lit("edge").alias("outcome"))
    diagonal = by_diagonal.select(F.col("id").alias("cid"), F.when(F.col("hit"), "diagonal").otherwise("discarded").alias("outcome"))
    return done.where("outcome IS NOT NULL").union(middle).union(edge).union(diagonal)


def outcome_counts(kept: DataFrame) -> DataFrame:
    return kept.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
