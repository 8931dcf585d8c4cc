"""Base meshes from size fields: an octree that is split level by level, one aggregation each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators.generate import axis_mesh
from meshloom.sources.shared import written

FILL = 0.9
LEAST_DEPTH, MOST_DEPTH = 2, 20


def target_sizes(gaps: DataFrame, levels: int) -> DataFrame:
    """(id, x, y, z, tx, ty, tz) of gaps (fid, diameter, m_x .. the centre, n_x .. the normal): cells may be long across the gap's normal."""
    sizes = [(F.col("diameter") / (F.abs(f"n_{c}") + 1e-4) * 2**levels).alias(f"t{c}") for c in "xyz"]
    return gaps.select(F.col("fid").alias("id"), *[F.col(f"m_{c}").alias(c) for c in "xyz"], *sizes)


def octree(field: DataFrame, lo, hi) -> tuple[DataFrame, int]:
    """(id, x, y, z, depth) of the leaf around each point (id, x, y, z, tx, ty, tz), and the depth to which the tree is complete.

    A cell is split while a point in it asks for less than FILL of its width along any axis.
    """
    live, done, depth, complete = field, None, 0, None
    while True:
        n = 1 << depth
        width = [(h - a) / n for a, h in zip(lo, hi, strict=True)]
        key = [F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col(c) - a) / w))) for c, a, w in zip("xyz", lo, width, strict=True)]
        small = F.lit(False)
        for c, w in zip("xyz", width, strict=True):
            small = small | (F.col(f"t{c}") < FILL * w)
        named = live.withColumns({f"_{c}": k for c, k in zip("xyz", key, strict=True)})
        split = named.groupBy("_x", "_y", "_z").agg(F.bool_or(small).alias("_split")).where("_split") if depth < MOST_DEPTH else named.limit(0).select("_x", "_y", "_z", F.lit(True).alias("_split"))
        tagged = written(named.join(split, ["_x", "_y", "_z"], "left").select(*field.columns, F.coalesce("_split", F.lit(False)).alias("_split")), "octree")
        cells = split.count()
        if complete is None and cells < 8**depth:
            complete = depth
        leaf = tagged.where("NOT _split").select("id", "x", "y", "z", F.lit(depth).alias("depth"))
        done = leaf if done is None else done.unionAll(leaf)
        if not cells:
            return done, complete or 0
        live, depth = tagged.where("_split").drop("_split"), depth + 1


def base_mesh(field: DataFrame, lo, hi) -> tuple[int, DataFrame]:
    """Cells a side of the uniform base mesh, and (vid, level): thirds by which it is to be refined around its vertices."""
    points, complete = octree(field, lo, hi)
    base = max(complete, LEAST_DEPTH)
    n = 1 << base
    level = F.ceil((F.greatest(F.col("depth"), F.lit(LEAST_DEPTH)) - base) * (math.log(2) / math.log(3))).cast("int")
    at = [F.least(F.lit(n), F.greatest(F.lit(0), F.ceil((F.col(c) - a) / ((h - a) / n) - 0.5))) for c, a, h in zip("xyz", lo, hi, strict=True)]
    vid = at[0] + (n + 1) * (at[1] + (n + 1) * at[2])
    return n, points.select(vid.cast("long").alias("vid"), F.greatest(level, F.lit(0)).alias("level")).groupBy("vid").agg(F.max("level").alias("level"))


def with_levels(spark: SparkSession, n: int, levels: DataFrame) -> DataFrame:
    """(vid, level) of all vertices of the base mesh."""
    every = axis_mesh(spark, (n, n, n), "vertex").select(F.col("id").alias("vid"))
    return every.join(levels, "vid", "left").select("vid", F.coalesce("level", F.lit(0)).alias("level"))
