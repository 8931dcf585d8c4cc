"""Cell volumes, per-vertex means and the size monitor of a volume mesh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions import vectors as V
from meshloom.operators import topology as T


def cell_volumes(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """(cid, volume)."""
    p = [V.field(F.col("p")[i]) for i in range(8)]
    return T.corners_of(cells, nodes).select("cid", V.hex_volume(p).alias("volume"))


def cell_bounds(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """(cid, lo_x .. hi_z): axis-aligned boxes."""
    lo, hi = V.bounds([V.field(F.col("p")[i]) for i in range(8)])
    named = [c.alias(f"{s}_{n}") for s, v in (("lo", lo), ("hi", hi)) for c, n in zip(v, "xyz", strict=True)]
    return T.corners_of(cells, nodes).select("cid", *named)


def vertex_means(cells: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """(vid, name): mean of a cell value over the cells around each vertex."""
    at = cells.select("cid", F.explode("kvert").alias("vid"))
    return at.join(values.select("cid", name), "cid").groupBy("vid").agg(F.avg(name).alias(name))


def cell_monitor(hits: DataFrame) -> DataFrame:
    """(cid, mis, area): the least inscribed size and the summed area of the surface pieces in each cell."""
    return hits.where("itype = 3").groupBy("cid").agg(F.min("mis").alias("mis"), F.sum("area").alias("area"))


def monitor_values(cells: DataFrame, monitored: DataFrame, gap: float) -> DataFrame:
    """(cid, value): 5 * gap / mis; cells without surface have the largest mis of all, and 0 if there is none."""
    most = monitored.agg(F.max("mis")).first()[0]
    rows = cells.select("cid").join(monitored.select("cid", "mis"), "cid", "left")
    if most is None:
        return rows.select("cid", F.lit(0.0).alias("value"))
    mis = F.coalesce("mis", F.lit(float(most)))
    return rows.select("cid", F.when(mis > 0, 5.0 * gap / mis).otherwise(0.0).alias("value"))
