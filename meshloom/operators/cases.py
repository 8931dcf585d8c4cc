"""Whole runs: smallest gap of a surface, cleaning of a volume mesh, correction of a case, reports."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions import vectors as V
from meshloom.operators import histogram as H
from meshloom.operators import monitor as M
from meshloom.operators import spatial as P
from meshloom.operators import surface as S
from meshloom.operators import topology as T
from meshloom.sources.config import EngineConfig


@dataclass(frozen=True)
class MinGap:
    """A surface's smallest gap, as found and as adjusted to the histogram, the span of its sizes and the size of coarse cells."""

    face: int | None
    raw: float
    adjusted: float
    min_bin: int
    max_bin: int
    span: int
    coarse: float


def gap_records(faces: DataFrame) -> DataFrame:
    """(fid, opposite, diameter, similarity, topo, back, dihedral) of every face.

    Topological distances are along edges from a face's corners to its opposite's, -1 if they aren't connected.
    """
    sphere = P.inscribed(faces)
    shape = S.measures(faces).select("fid", "n_x", "n_y", "n_z")
    other = shape.select(F.col("fid").alias("opposite"), *[F.col(f"n_{c}").alias(f"o_{c}") for c in "xyz"])
    similar = F.col("n_x") * F.col("o_x") + F.col("n_y") * F.col("o_y") + F.col("n_z") * F.col("o_z")
    rows = T.written(sphere.join(shape, "fid").join(other, "opposite", "left").select("fid", "opposite", "diameter", similar.alias("similarity")), "spheres")
    size = S.mesh_size(vertices(faces)).first()["size"] or 0.0
    topo = T.written(topological_distances(faces, rows, size), "topo")
    back = topo.toDF("opposite", "back")
    return rows.join(topo, "fid").join(back, "opposite", "left").join(S.dihedral(faces), "fid", "left")


def vertices(faces: DataFrame) -> DataFrame:
    """(vid, x, y, z) of the corners of faces."""
    parts = F.array(*[F.struct(F.col("v")[i].alias("vid"), *[F.col(f"{p}_{c}").alias(c) for c in "xyz"]) for i, p in enumerate("abc")])
    return faces.select(F.inline(parts)).distinct()


def topological_distances(faces: DataFrame, records: DataFrame, size: float) -> DataFrame:
    """(fid, topo): lengths of the shortest edge paths from the corners of each face to those of its opposite (fid, opposite, diameter).

    -1 without an opposite, and where no path is short enough: pi times the diameter, SEARCH_RADIUS of the surface's size at least.
    All searches advance at once, an edge in each round: what lies at the front is joined with the edges, and goes on where it is the
    shortest way so far and its length and the straight way to the goal are within the bound, which falls to the best path found.
    So a search stays near the straight way and ends soon after it has met its goal. Each round is written.
    """
    points = T.written(vertices(faces), "points")
    place = lambda name: points.select(F.col("vid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in "xyz"])
    both = T.triangle_edges(faces.select("fid", "v")).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct()
    ends = both.join(place("a"), "a").join(place("b"), "b")
    edges = T.written(ends.select("a", "b", *[f"b_{c}" for c in "xyz"], V.distance(V.vec("a"), V.vec("b")).alias("length")), "edges")
    corners = faces.select("fid", "v", F.array(*[F.struct(*[F.col(f"{p}_{c}").alias(c) for c in "xyz"]) for p in "abc"]).alias("p"))
    bound = F.greatest(math.pi * F.col("diameter"), F.lit(float(S.SEARCH_RADIUS * size)))
    pairs = records.where("opposite IS NOT NULL").select("fid", "opposite", bound.alias("bound")).join(corners, "fid")
    pairs = pairs.join(corners.select(F.col("fid").alias("opposite"), F.col("v").alias("goal"), F.col("p").alias("goals")), "opposite")

    def straight(p: V.Vector) -> Column:
        """From a point to the nearest corner of the goal."""
        return F.array_min(F.transform("goals", lambda g: V.distance(p, V.field(g))))

    start = pairs.select("fid", "bound", "goal", "goals", F.explode(F.arrays_zip("v", "p")).alias("s")).select("fid", F.col("s.v").alias("vid"), F.lit(0.0).alias("d"), "bound", "goal", "goals", straight(V.field(F.col("s.p"))).alias("ahead"))
    front = T.written(start.where("ahead <= bound").drop("ahead"), "front")
    reached = [front.where(F.array_contains("goal", F.col("vid"))).select("fid", "d")]
    # a path of no length ends a search at once
    front = front.join(reached[0].select("fid").distinct(), "fid", "left_anti")
    best = T.written(front.select("fid", "vid", "d"), "best")
    front = T.written(front, "front")
    slack = 1 + 1e-12
    while not front.isEmpty():
        ways = front.withColumnRenamed("vid", "a").join(edges, "a").withColumn("d", F.col("d") + F.col("length"))
        ways = ways.where((F.col("d") <= F.col("bound")) & (F.col("d") + straight(V.vec("b")) <= F.col("bound") * slack))
        ways = ways.groupBy("fid", F.col("b").alias("vid")).agg(F.min("d").alias("d"), F.min("bound").alias("bound"), F.first("goal").alias("goal"), F.first("goals").alias("goals"))
        known = best.select("fid", "vid", F.col("d").alias("old"))
        ways = ways.join(known, ["fid", "vid"], "left").where("old IS NULL OR d < old").drop("old")
        met = F.min(F.when(F.array_contains("goal", F.col("vid")), F.col("d"))).over(Window.partitionBy("fid"))
        ways = T.written(ways.withColumn("bound", F.least("bound", met)), "front")
        reached.append(ways.where(F.array_contains("goal", F.col("vid"))).select("fid", "d"))
        best = T.written(best.union(ways.select("fid", "vid", "d")).groupBy("fid", "vid").agg(F.min("d").alias("d")), "best")
        front = ways.where(~F.array_contains("goal", F.col("vid")) & (F.col("d") < F.col("bound")))
    found = reduce(DataFrame.union, reached).groupBy("fid").agg(F.min("d").alias("topo"))
    return records.select("fid").join(found, "fid", "left").select("fid", F.coalesce("topo", F.lit(-1.0)).alias("topo"))


def find_min_gap(sv: DataFrame, sf: DataFrame, config: EngineConfig | None = None) -> tuple[MinGap, DataFrame]:
    """The smallest gap of a surface, and its faces with diameter, score, validity and monitor."""
    config = config or EngineConfig()
    size = S.mesh_size(sv).first()["size"]
    faces = T.written(S.usable(S.corners(sv, sf), size), "faces")
    records = T.written(gap_records(faces), "records")
    scores = T.written(S.gap_scores(faces, records, P.crossings(faces), size), "scores")
    pick = S.min_gap(scores).first()
    raw = float(pick["diameter"]) if pick else 0.0
    monitor = records.select("fid", "diameter", F.col("diameter").alias("monitor"))
    rows = S.measures(faces).select("fid", "area").join(monitor, "fid").join(S.validity(faces, records), "fid")
    bins = T.written(H.log_histogram(rows, "monitor", "area", raw if raw > 0 else None, config.monitor_histogram_base), "bins")
    adjusted = H.adjusted_minimum(bins, raw, config.histogram_target_fraction).first()["adjusted"]
    lo, hi = H.min_max_bins(bins, config.histogram_min_fraction_threshold, config.histogram_max_fraction_threshold, config.max_histogram_span_bins).first() or (0, 0)
    lo, hi = lo or 0, hi or 0
    span = max(config.min_histogram_span_bins, min(config.max_histogram_span_bins, hi - lo))
    out = S.invalidate_below(rows, adjusted).join(scores.select("fid", "opposite", "score"), "fid")
    return MinGap(pick["fid"] if pick else None, raw, adjusted, lo, hi, span, coarse_size(adjusted, span, config)), out


def coarse_size(gap: float, span: int, config: EngineConfig | None = None) -> float:
    return gap * (config or EngineConfig()).coarse_mesh_scaling * 3.0**span


def corrected(size: float, span: int, first_bin_percent: float, config: EngineConfig | None = None) -> tuple[float, int] | None:
    """Size and span of the one rerun of a case whose first volume bin is nearly empty; None if there is no need."""
    if first_bin_percent > (config or EngineConfig()).monitor_zero_bin_threshold_percent:
        return None
    return size / 3.0, max(1, span - 1)


def clean(nodes: DataFrame, cells: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and cells that touch the solid, numbered anew, and how many cells had which outcome."""
    kept = T.written(P.keep_cells(T.corners_of(cells, nodes), faces), "kept")
    new_nodes, new_cells = T.reduce_mesh(nodes, cells, kept.where("outcome <> 'discarded'"))
    return T.recompute_knpr(new_nodes, new_cells), new_cells, P.outcome_counts(kept)


def monitor(nodes: DataFrame, cells: DataFrame, faces: DataFrame, sizes: DataFrame, gap: float, grid: float) -> DataFrame:
    """(cid, value): the size monitor of each cell from the surface pieces in it; sizes is (fid, mis)."""
    pairs = P.overlap_join(M.cell_bounds(nodes, cells).withColumnRenamed("cid", "id"), P.triangle_boxes(faces), grid)
    pieces = P.clip_cells(T.corners_of(cells, nodes), faces, pairs).join(sizes, "fid")
    return M.monitor_values(cells, M.cell_monitor(pieces), gap)


def report(sv: DataFrame, sf: DataFrame) -> DataFrame:
    """(key, value) of a surface, in long form."""
    faces = S.corners(sv, sf)
    one = F.lit(1)
    row = T.surface_summary(sf).withColumn("k", one).join(S.mesh_size(sv).withColumn("k", one), "k").join(S.orientation(faces).withColumn("k", one), "k")
    shape = S.measures(faces).agg(F.min("aspect").alias("least_aspect"), F.max("aspect").alias("most_aspect"), F.sum("area").alias("area"))
    defects = S.warnings(faces).groupBy().agg(*[F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("degenerate", "anisotropic")])
    row = row.join(shape.withColumn("k", one), "k").join(defects.fillna(0).withColumn("k", one), "k").drop("k")
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in row.columns])))


def valid_for_queries(sv: DataFrame, sf: DataFrame) -> str | None:
    """Why a surface can't be queried, or None: it must be closed, of sound triangles, and must not cross itself."""
    summary = T.surface_summary(sf).first()
    faces = S.corners(sv, sf)
    if not summary["closed"]:
        return "the surface is not closed"
    if n := faces.where(S.degenerate()).count():
        return f"{n} degenerate triangles"
    if n := P.crossings(faces).count():
        return f"{n} pairs of triangles cross"
    return None


def batch_summary(results: DataFrame) -> DataFrame:
    """(line): a row of text for each case (case, status, seconds, nel, nvt)."""
    return results.orderBy("case").select(F.format_string("%-24s %-8s %10.3f s  NEL %10d  NVT %10d", "case", "status", "seconds", "nel", "nvt").alias("line"))
