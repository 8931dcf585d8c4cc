"""Round geometry: loops of a slice, the axis, radii, extrusion."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions import vectors as V
from meshloom.operators import surface as S
from meshloom.operators import topology as T
from meshloom.operators.boundary import Inflow


def oriented_segments(faces: DataFrame, z: float) -> DataFrame:
    """(fid, s, e, p_x, p_y, q_x, q_y): where triangles cross a plane, from the edge that rises (key s) to the one that falls (e).

    Edges are known by their vertices, so neighbours share keys exactly; consistent triangles give consistent loops.
    """
    ends = []
    for i, j in (("a", "b"), ("b", "c"), ("c", "a")):
        p, q, k, m = V.vec(i), V.vec(j), "abc".index(i), "abc".index(j)
        t = F.try_divide(z - p[2], q[2] - p[2])
        key = F.xxhash64(F.least(F.col("v")[k], F.col("v")[m]), F.greatest(F.col("v")[k], F.col("v")[m]))
        at = F.struct(key.alias("k"), (p[0] + t * (q[0] - p[0])).alias("x"), (p[1] + t * (q[1] - p[1])).alias("y"))
        ends.append((F.when((p[2] < z) & (q[2] >= z), at), F.when((p[2] >= z) & (q[2] < z), at)))
    up, down = (F.coalesce(*[e[i] for e in ends]) for i in (0, 1))
    rows = faces.select("fid", up.alias("u"), down.alias("d")).where("u IS NOT NULL AND d IS NOT NULL")
    return rows.select("fid", F.col("u.k").alias("s"), F.col("d.k").alias("e"), F.col("u.x").alias("p_x"), F.col("u.y").alias("p_y"), F.col("d.x").alias("q_x"), F.col("d.y").alias("q_y"))


def loops(segments: DataFrame) -> DataFrame:
    """segments with loop, the area it encloses and whether it is closed; the area is a sum over segments in any order."""
    links = segments.select(F.col("s").alias("a"), F.col("e").alias("b"))
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = T.written(segments.join(T.components(ids, links).toDF("s", "loop"), "s"), "loops")
    ends = rows.select("loop", F.explode(F.array("s", "e")).alias("k")).groupBy("loop", "k").agg(F.count(F.lit(1)).alias("n"))
    closed = ends.groupBy("loop").agg(F.bool_and(F.col("n") == 2).alias("closed"))
    area = rows.groupBy("loop").agg(F.abs(F.sum(F.col("p_x") * F.col("q_y") - F.col("q_x") * F.col("p_y")) / 2).alias("area"))
    return rows.join(closed, "loop").join(area, "loop")


@dataclass(frozen=True)
class RoundGeometry:
    center: tuple[float, float]
    aligned: bool
    outer_diameter: float
    inner_diameter: float
    ratio: float
    kind: str
    extrusion: float
    consistent: bool
    z_min: float
    z_max: float


def analyse(sv: DataFrame, sf: DataFrame, inflows: list[Inflow], below_top: float = 1e-3, alignment: float = 1e-4, axial_degrees: float = 5.0, consistency: float = 1e-3, full_ratio: float = 0.1) -> RoundGeometry:
    """Axis, radii and extrusion of a round surface whose inflows look inward."""
    faces = T.written(S.corners(sv, sf), "faces")
    box = S.mesh_size(sv).first()
    if box["size"] is None or box["hi_z"] <= box["lo_z"]:
        raise ValueError("the surface has no extent along z")
    top = box["hi_z"] - below_top * (box["hi_z"] - box["lo_z"])
    found = loops(oriented_segments(faces, top)).where("closed")
    best = found.agg(F.max_by("loop", F.struct("area", "loop")).alias("loop")).first()["loop"]
    fit = S.circle_fit(found.where(F.col("loop") == best).select(F.col("p_x").alias("x"), F.col("p_y").alias("y"))).first() if best is not None else None
    if fit is None:
        raise ValueError("no circle fits the slice below the top")
    center = (fit["cx"], fit["cy"])
    reach = S.axis_distances(faces, center).first()
    outer, inner, limited, known = reach["most"], reach["least"], False, []
    for k, flow in enumerate(inflows):
        if flow.center is None or flow.normal is None or not any(flow.normal):
            continue
        size = math.sqrt(sum(x * x for x in flow.normal))
        n = tuple(x / size for x in flow.normal)
        dx, dy = flow.center[0] - center[0], flow.center[1] - center[1]
        r, flat = math.hypot(dx, dy), math.hypot(n[0], n[1])
        least = max(box["size"] * 1e-6, 1e-9)
        if r > least and flat > least and (n[0] * dx + n[1] * dy) / (r * flat) < 0:
            outer = min(outer, r)
        limited = limited or n[2] > math.cos(math.radians(axial_degrees))
        known.append((k, flow.center, n))
    if not known:
        raise ValueError("no inflow tells the extrusion")
    if outer <= 0:
        raise ValueError("the outer radius is not positive")
    depths = sorted(r["depth"] for r in S.extrusions(sv, known).collect())  # one for each inflow
    extrusion = depths[len(depths) // 2]
    slack = max(box["size"] * 1e-8, consistency * max(extrusion, 1.0))
    ratio = 2 * inner / (2 * outer)
    return RoundGeometry(
        center,
        abs(center[0]) <= alignment and abs(center[1]) <= alignment,
        2 * outer,
        max(0.0, 2 * inner),
        ratio,
        "FullCylinder" if ratio < full_ratio else "HollowCylinder",
        extrusion,
        all(abs(d - extrusion) <= slack for d in depths),
        box["lo_z"] + (extrusion if limited else 0.0),
        box["hi_z"] - extrusion,
    )


def rewrite_settings(lines: list[str], section: str, values: dict[str, str]) -> list[str]:
    """Lines of a settings file with these values in a section: keys that are there are replaced, others added at its end."""
    out, inside, left, last = [], False, {k.lower(): (k, v) for k, v in values.items()}, None
    for line in lines:
        text = line.strip()
        if text.startswith("["):
            inside = text.strip("[]").lower() == section.lower()
        key = text.split("=", 1)[0].strip().lower() if inside and "=" in text else None
        if key in left:
            name, value = left.pop(key)
            line = f"{name} = {value}"
        out.append(line)
        if inside and text:
            last = len(out)
    added = [f"{k} = {v}" for k, v in left.values()]
    if last is None:
        return [*out, f"[{section}]", *added]
    return [*out[:last], *added, *out[last:]]
