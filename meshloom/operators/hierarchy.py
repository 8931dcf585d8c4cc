"""A hierarchy of boxes over a surface, and searches that go down it level by level.

Triangles are put in the order of interleaved bits of their middles and numbered. Node k of level l holds those numbered from
k * 8^l up to (k + 1) * 8^l, with the box around them and one corner of theirs, so nodes are equally full however triangles crowd.
A search keeps, for each query, the nodes that may hold what it looks for, and joins them with their eight children, level by
level; at the end it meets the triangles of the last nodes. Rays, and points near the surface, meet a number of triangles that does
not grow with the surface; points far off, to whom boxes look nearer than what is in them, meet about as many as the root of its
size. Levels of up to MOST_SENT nodes are sent to all tasks, larger ones are joined by node.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions import vectors as V
from meshloom.operators import topology as T
from meshloom.sources.shared import written

#: Bits of a coordinate in the order of triangles, and of a node's number that tell its children apart.
BITS, FAN = 16, 3
#: Nodes of a level that are sent to all tasks: about 12 MB.
MOST_SENT = 1 << 17
#: Levels that lines go down before they are dealt anew.
STEPS = 2
#: Lower bounds may be off by rounding.
SLACK = 1 + 1e-9


@dataclass(frozen=True)
class Hierarchy:
    """faces (fid, a_x .. c_z, leaf); nodes (level, node, lo_x .. hi_z, s_x, s_y, s_z) of levels 1 to top; n faces."""

    faces: DataFrame
    nodes: DataFrame
    top: int
    n: int

    def level(self, k: int) -> DataFrame:
        rows = self.nodes.where(F.col("level") == k).select(F.shiftright("node", FAN).alias("_up"), F.col("node").alias("_node"), *[f"{s}_{c}" for s in ("lo", "hi", "s") for c in "xyz"])
        return F.broadcast(rows) if self.n >> (FAN * k) < MOST_SENT else rows


def hierarchy(faces: DataFrame) -> Hierarchy | None:
    """Of the faces (fid, a_x .. c_z) whose corners are numbers; None if there are none."""
    corners = [f"{p}_{c}" for p in "abc" for c in "xyz"]
    lo, hi = V.bounds([V.vec("a"), V.vec("b"), V.vec("c")])
    sound = reduce(lambda p, q: p & q, [F.abs(F.col(c)) < float("inf") for c in corners])
    boxes = faces.where(sound).select("fid", *corners, *[x.alias(f"{s}_{c}") for s, v in (("lo", lo), ("hi", hi)) for x, c in zip(v, "xyz", strict=True)])
    whole = boxes.agg(F.count(F.lit(1)).alias("n"), *[F.min(f"lo_{c}").alias(f"lo_{c}") for c in "xyz"], *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in "xyz"]).first()
    if not whole["n"]:
        return None
    extent = max(whole[f"hi_{c}"] - whole[f"lo_{c}"] for c in "xyz") or 1.0
    code = F.lit(0).cast("long")
    for i, c in enumerate("xyz"):
        place = F.floor((((F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2 - whole[f"lo_{c}"]) / extent) * ((1 << BITS) - 1)).cast("long")
        for b in range(BITS):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(place, b).bitwiseAND(F.lit(1).cast("long")), 3 * b + i))
    ranked = written(T.dense_ids(boxes.withColumn("_code", code), ["_code", "fid"], "_rank", first=0), "ranked")
    top = 1
    while (whole["n"] - 1) >> (FAN * top):
        top += 1
    levels = ranked.select("_rank", *[f"{s}_{c}" for s in ("lo", "hi") for c in "xyz"], *[f"a_{c}" for c in "xyz"], F.explode(F.sequence(F.lit(1), F.lit(top))).alias("level"))
    levels = levels.withColumn("node", F.expr(f"shiftright(_rank, {FAN} * level)"))
    some = F.min(F.struct("_rank", *[f"a_{c}" for c in "xyz"])).alias("s")
    nodes = levels.groupBy("level", "node").agg(*[F.min(f"lo_{c}").alias(f"lo_{c}") for c in "xyz"], *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in "xyz"], some)
    nodes = written(nodes.select("level", "node", *[f"{s}_{c}" for s in ("lo", "hi") for c in "xyz"], *[F.col(f"s.a_{c}").alias(f"s_{c}") for c in "xyz"]), "nodes")
    return Hierarchy(ranked.select("fid", *corners, F.shiftright("_rank", FAN).alias("_leaf")), nodes, top, whole["n"])


def _of(faces: DataFrame | Hierarchy) -> Hierarchy | None:
    return faces if isinstance(faces, Hierarchy) else hierarchy(faces)


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda p, q: p + q, parts)


def _triangles(met: DataFrame, tree: Hierarchy) -> DataFrame:
    """Queries with the triangles (r_fid, r_a_x ..) of their nodes."""
    faces = tree.faces.withColumnsRenamed({c: f"r_{c}" for c in tree.faces.columns if c != "_leaf"})
    return met.join(faces, met["_node"] == faces["_leaf"]).drop("_node", "_leaf")


def near_triangles(points: DataFrame, tree: Hierarchy) -> DataFrame:
    """Points (id, x, y, z, _bound and more) with the triangles (r_fid, r_a_x ..) that may be nearest.

    _bound is a squared distance within which there is a point of the surface, or infinite. Each node shows such a point, so the
    bound falls from level to level, and nodes whose boxes lie beyond it go.
    """
    met = points.repartition("id").withColumn("_node", F.lit(0).cast("long"))
    kept = met.columns
    near = [F.greatest(F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}"), F.lit(0.0)) for c in "xyz"]
    shown = _sum([(F.col(f"s_{c}") - F.col(c)) * (F.col(f"s_{c}") - F.col(c)) for c in "xyz"])
    for k in range(tree.top, 0, -1):
        met = met.withColumnRenamed("_node", "_up").join(tree.level(k), "_up")
        met = met.withColumn("_bound", F.least("_bound", F.min(shown * SLACK).over(Window.partitionBy("id"))))
        met = met.where(_sum([g * g for g in near]) <= F.col("_bound") * SLACK).select(*kept)
    return _triangles(met, tree)


def nearest(points: DataFrame, faces: DataFrame | Hierarchy, reach: Column | None = None) -> DataFrame:
    """(id, distance, fid): the nearest triangle of each point (id, x, y, z), ties to the lowest.

    reach, if given, is a distance within which the surface is known to have a point of each.
    """
    tree = _of(faces)
    if tree is None:
        return points.sparkSession.createDataFrame([], "id long, distance double, fid long")
    bound = F.lit(float("inf")) if reach is None else reach * reach * SLACK
    rows = points.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"], bound.alias("_bound")).dropna()
    met = near_triangles(rows, tree)
    gap = V.point_triangle_distance2((F.col("x"), F.col("y"), F.col("z")), *[V.vec(f"r_{p}") for p in "abc"])
    best = met.groupBy("id").agg(F.min(F.struct(gap.alias("gap"), F.col("r_fid").alias("fid"))).alias("m"))
    return best.select("id", F.sqrt("m.gap").alias("distance"), "m.fid")


def crossed_boxes(lines: DataFrame, tree: Hierarchy) -> DataFrame:
    """Lines (x .., dx .., most and more), up to most times their direction, with the triangles whose nodes' boxes they cross."""
    met = lines.withColumns({"_node": F.lit(0).cast("long"), **{f"_i{c}": F.when(F.col(f"d{c}") != 0, 1 / F.col(f"d{c}")) for c in "xyz"}})
    kept = met.columns
    first, last, beside = [F.lit(0.0)], [F.col("most")], []
    for c in "xyz":
        # along a side the inverse is null, which greatest and least pass over, and the line is beside the box or not
        lo, hi = F.col(f"lo_{c}") - F.col(c), F.col(f"hi_{c}") - F.col(c)
        first.append(F.least(lo * F.col(f"_i{c}"), hi * F.col(f"_i{c}")))
        last.append(F.greatest(lo * F.col(f"_i{c}"), hi * F.col(f"_i{c}")))
        beside.append((F.col(f"_i{c}").isNull()) & ((lo > 0) | (hi < 0)))
    for k in range(tree.top, 0, -1):
        nodes = tree.level(k)
        wide = {f"{s}_{c}": F.col(f"{s}_{c}") + sign * (1e-9 * (F.abs(f"lo_{c}") + F.abs(f"hi_{c}")) + 1e-12) for s, sign in (("lo", -1), ("hi", 1)) for c in "xyz"}
        met = met.withColumnRenamed("_node", "_up").join(nodes.withColumns(wide), "_up").where(F.greatest(*first) <= F.least(*last)).where(~reduce(lambda p, q: p | q, beside)).select(*kept)
        if (tree.top - k) % STEPS == STEPS - 1:
            met = met.repartition("id")  # what lines meet differs; dealt anew, tasks stay even and their code short
    met = met.drop(*[f"_i{c}" for c in "xyz"])
    return _triangles(met, tree)


def along(met: DataFrame) -> DataFrame:
    """Pairs of lines (x .., dx ..) and triangles (r_a_x ..) that meet, with t, the place on the line in units of its direction."""
    a, b, c = (V.vec(f"r_{p}") for p in "abc")
    d, u, v = tuple(F.col(f"d{k}") for k in "xyz"), V.sub(b, a), V.sub(c, a)
    h, s = V.cross(d, v), V.sub((F.col("x"), F.col("y"), F.col("z")), a)
    det, q = V.dot(u, h), V.cross(s, u)
    rows = met.where(F.abs(det) > 1e-12).withColumns({"_p": F.try_divide(V.dot(s, h), det), "_q": F.try_divide(V.dot(d, q), det), "t": F.try_divide(V.dot(v, q), det)})
    return rows.where((F.col("_p") >= 0) & (F.col("_q") >= 0) & (F.col("_p") + F.col("_q") <= 1) & (F.col("t") >= 0))


def first_hits(rays: DataFrame, faces: DataFrame | Hierarchy) -> DataFrame:
    """(id, distance, fid): the first triangle that each ray (id, x, y, z, dx, dy, dz, own) meets in front, not counting its own."""
    tree = _of(faces)
    if tree is None:
        return rays.select("id", F.lit(None).cast("double").alias("distance"), F.lit(None).cast("long").alias("fid"))
    own = rays if "own" in rays.columns else rays.withColumn("own", F.lit(-1).cast("long"))
    lines = own.select("id", "x", "y", "z", "dx", "dy", "dz", "own").dropna().withColumn("most", F.lit(float("inf"))).where("dx <> 0 OR dy <> 0 OR dz <> 0")
    met = along(crossed_boxes(lines, tree)).where("t > 1e-12 AND own <> r_fid")
    best = met.groupBy("id").agg(F.min(F.struct(F.col("t").alias("distance"), F.col("r_fid").alias("fid"))).alias("m"))
    return rays.select("id").join(best, "id", "left").select("id", "m.distance", "m.fid")


def segments_hit(segments: DataFrame, faces: DataFrame | Hierarchy) -> DataFrame:
    """(id, hit): whether any of the segments (id, x, y, z, ex, ey, ez) of an id meets the surface."""
    every, tree = segments.select("id").distinct(), _of(faces)
    if tree is None:
        return every.select("id", F.lit(False).alias("hit"))
    lines = segments.select("id", "x", "y", "z", *[(F.col(f"e{c}") - F.col(c)).alias(f"d{c}") for c in "xyz"]).dropna().withColumn("most", F.lit(1.0))
    met = along(crossed_boxes(lines, tree)).where("t <= 1")
    return every.join(met.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("hit"))
