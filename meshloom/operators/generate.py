"""Structured hexahedral meshes as tables that are computed from row numbers: no joins, any size.

Nodes are (vid, x, y, z, knpr), cells (cid, kvert) with eight node ids; ids count from 1. knpr is 1 on the boundary.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The most rows that a task makes: larger meshes have more tasks, not longer ones.
TASK_ROWS = 1 << 22
#: Nodes along x that lie in a block of rows of a tensor grid's edges and faces.
BLOCK = 32


def elements(span: float, size: float, least: int = 1) -> int:
    """How many elements of about this size fill a span."""
    if span <= 0 or size <= 0:
        raise ValueError("span and size must be positive")
    return max(least, math.ceil(span / size))


def _given_or(given: int | None, span: float, grid: float | None, factor: float, least: int = 1) -> int:
    if given is None and grid is None:
        raise ValueError("a count or a grid size is needed")
    n = given if given is not None else elements(span, grid * factor, least)
    if n <= 0 or factor <= 0:
        raise ValueError("counts and factors must be positive")
    return n


def box_resolution(lengths, counts=(None, None, None), grid: float | None = None, factors=(1.0, 1.0, 1.0)) -> tuple[int, int, int]:
    return tuple(_given_or(n, span, grid, f) for n, span, f in zip(counts, lengths, factors, strict=True))


def annulus_resolution(outer: float, inner: float, length: float, counts=(None, None, None), grid: float | None = None, factors=(1.0, 1.0, 1.0)) -> tuple[int, int, int]:
    """Tangential (along the mean circumference), radial, axial; outer and inner are diameters."""
    if outer <= inner:
        raise ValueError("the outer diameter must exceed the inner one")
    spans = (2 * math.pi * 0.5 * (outer / 2 + inner / 2), outer / 2 - inner / 2, length)
    return tuple(_given_or(n, span, grid, f, least) for n, span, f, least in zip(counts, spans, factors, (3, 1, 1), strict=True))


def cylinder_resolution(outer: float, length: float, periods: int, counts=(None, None, None), grid: float | None = None, factors=(1.0, 1.0, 1.0)) -> tuple[int, int, int]:
    """Inner rings, outer rings, layers of a full cylinder."""
    n_inner, n_outer, n_z = counts
    if n_inner is None:
        around = elements(2 * math.pi * outer / 2, grid * factors[0], 2 * periods)
        n_inner = max(1, math.ceil(around / (2 * periods)))
    if n_outer is None:
        n_outer = max(1, elements(outer / 2, grid * factors[1]) - n_inner)
    return n_inner, n_outer, _given_or(n_z, length, grid, factors[2])


def _index(id_: Column, *sizes: int) -> list[Column]:
    """Mixed-radix digits of id - 1, the fastest first; the last digit is unbounded."""
    out, rest = [], id_ - 1
    for n in sizes:
        out.append(F.pmod(rest, F.lit(n)))
        rest = F.floor(rest / n)
    return [*out, rest]


def _hexes(corner, lift: Column | int) -> Column:
    """Eight corners from the four of the lower side, the upper ones being `lift` higher."""
    return F.array(*[c.cast("long") for c in corner], *[(c + lift).cast("long") for c in corner])


def numbers(spark: SparkSession, start: int, stop: int, each: int = 1) -> DataFrame:
    """The ids start to stop - 1, at most TASK_ROWS in a partition; fewer where each of them makes some rows."""
    parts = math.ceil((stop - start) * each / TASK_ROWS)
    return spark.range(start, stop, 1, max(parts, spark.sparkContext.defaultParallelism))


def box_nodes(spark: SparkSession, start, lengths, n) -> DataFrame:
    (nx, ny, nz), at = n, F.col("vid")
    i, j, k = _index(at, nx + 1, ny + 1)
    x, y, z = (F.lit(float(s)) + F.lit(float(length)) * c / m for s, length, c, m in zip(start, lengths, (i, j, k), n, strict=True))
    edge = (i == 0) | (i == nx) | (j == 0) | (j == ny) | (k == 0) | (k == nz)
    rows = numbers(spark, 1, (nx + 1) * (ny + 1) * (nz + 1) + 1).withColumnRenamed("id", "vid")
    return rows.select("vid", x.alias("x"), y.alias("y"), z.alias("z"), edge.cast("int").alias("knpr"))


def box_cells(spark: SparkSession, n) -> DataFrame:
    nx, ny, nz = n
    i, j, k = _index(F.col("cid"), nx, ny)
    a = i + (nx + 1) * (j + (ny + 1) * k) + 1
    kvert = _hexes((a, a + 1, a + nx + 2, a + nx + 1), (nx + 1) * (ny + 1))
    return numbers(spark, 1, nx * ny * nz + 1).withColumnRenamed("id", "cid").select("cid", kvert.alias("kvert"))


def annulus_nodes(spark: SparkSession, outer: float, inner: float, length: float, start_z: float, n, theta0: float | None = None) -> DataFrame:
    nt, nr, nz = n
    step = 2 * math.pi / nt
    theta0 = math.pi / 2 - step if theta0 is None else theta0
    t, r, k = _index(F.col("vid"), nt, nr + 1)
    radius = F.lit(inner / 2) + F.lit(outer / 2 - inner / 2) * r / nr
    theta = F.lit(theta0) + t * F.lit(step)
    edge = (k == 0) | (k == nz) | (r == 0) | (r == nr)
    rows = spark.range(1, nt * (nr + 1) * (nz + 1) + 1).withColumnRenamed("id", "vid")
    return rows.select("vid", (radius * F.cos(theta)).alias("x"), (radius * F.sin(theta)).alias("y"), (F.lit(float(start_z)) + F.lit(float(length)) * k / nz).alias("z"), edge.cast("int").alias("knpr"))


def annulus_cells(spark: SparkSession, n) -> DataFrame:
    nt, nr, nz = n
    t, r, k = _index(F.col("cid"), nt, nr)

    def node(t: Column, r: Column) -> Column:
        return t + nt * (r + (nr + 1) * k) + 1

    after = F.pmod(t + 1, F.lit(nt))
    kvert = _hexes((node(t, r), node(after, r), node(after, r + 1), node(t, r + 1)), nt * (nr + 1))
    return spark.range(1, nt * nr * nz + 1).withColumnRenamed("id", "cid").select("cid", kvert.alias("kvert"))


@dataclass(frozen=True)
class Disc:
    """The cross-section of a full cylinder.

    Each of `periods` sectors holds an n_inner x n_inner grid of squares with coordinates (a, b) whose node (a, b) lies on ring
    max(a, b); ring j has 2 * periods * j nodes. Outer rings all have as many nodes as the last inner one.
    """

    periods: int
    n_inner: int
    n_outer: int

    @property
    def around(self) -> int:
        return 2 * self.periods * self.n_inner

    @property
    def inner_nodes(self) -> int:
        return 1 + self.periods * self.n_inner * (self.n_inner + 1)

    @property
    def nodes(self) -> int:
        return self.inner_nodes + self.n_outer * self.around

    @property
    def inner_cells(self) -> int:
        return self.periods * self.n_inner**2

    @property
    def cells(self) -> int:
        return self.inner_cells + self.n_outer * self.around

    def ring(self, node: Column) -> tuple[Column, Column, Column]:
        """Ring, place on it and number of nodes on it, of the node-th node of a level, from 0; the centre is ring 0."""
        p = self.periods
        j = F.when(node == 0, 0).otherwise(F.ceil((F.sqrt(1 + 4.0 * node / p) - 1) / 2)).cast("long")
        # the root may be off by one at ring borders
        j = F.when((node > 0) & (node <= p * j * (j - 1)), j - 1).when(node > p * j * (j + 1), j + 1).otherwise(j)
        beyond = node - self.inner_nodes
        outer = beyond >= 0
        j = F.when(outer, self.n_inner + 1 + F.floor(beyond / self.around)).otherwise(j)
        place = F.when(outer, F.pmod(beyond, F.lit(self.around))).when(node == 0, 0).otherwise(node - 1 - p * j * (j - 1))
        return j, place, F.when(outer, self.around).otherwise(F.greatest(2 * p * j, F.lit(1)))

    def inner_node(self, j: Column, sector: Column, offset: Column) -> Column:
        """The number, from 1, of a node on ring j of the core."""
        p = self.periods
        return F.when(j == 0, 1).otherwise(2 + p * j * (j - 1) + F.pmod(sector * 2 * j + offset, F.greatest(2 * p * j, F.lit(1))))

    def outer_node(self, ring: Column, place: Column) -> Column:
        """The same on the ring-th ring from the core's edge (0)."""
        return 2 + self.periods * self.n_inner * (self.n_inner - 1) + ring * self.around + F.pmod(place, F.lit(self.around))

    def corners(self, cells: DataFrame) -> DataFrame:
        """Adds c0..c3, the four nodes, from 1, of the cell-th cell of a layer (_cell, from 0).

        Every step is a column of its own, so that no expression is written out more than once.
        """
        p, cell = self.periods, F.col("_cell")
        j = F.floor(F.sqrt(cell / p)).cast("long") + 1
        rows = cells.withColumn("_j", j).withColumn("_j", F.when(cell < p * (F.col("_j") - 1) * (F.col("_j") - 1), F.col("_j") - 1).when(cell >= p * F.col("_j") * F.col("_j"), F.col("_j") + 1).otherwise(F.col("_j")))
        j = F.col("_j")
        rows = rows.withColumn("_rank", cell - p * (j - 1) * (j - 1)).withColumns({"_s": F.floor(F.col("_rank") / (2 * j - 1)), "_q": F.pmod("_rank", 2 * j - 1)})
        sector, q = F.col("_s"), F.col("_q")
        # before the diagonal square, on it, after it: places of the first corner, and ring and place of the third and fourth
        rows = rows.withColumns({
            "_a": F.when(q < j, q).otherwise(q + 1),
            "_r": F.when(q == j - 1, j).otherwise(j - 1),
            "_b": F.when(q < j - 1, q + 1).when(q == j - 1, q + 2).otherwise(q),
            "_c": F.when(q < j, q).otherwise(q - 1),
            "_ring": F.floor((cell - self.inner_cells) / self.around),
            "_i": F.pmod(cell - self.inner_cells, F.lit(self.around)),
        })
        ring, i = F.col("_ring"), F.col("_i")
        core = [self.inner_node(j, sector, F.col("_a")), self.inner_node(j, sector, F.col("_a") + 1), self.inner_node(F.col("_r"), sector, F.col("_b")), self.inner_node(j - 1, sector, F.col("_c"))]
        shell = [self.outer_node(ring + 1, i), self.outer_node(ring + 1, i + 1), self.outer_node(ring, i + 1), self.outer_node(ring, i)]
        out = rows.withColumns({f"c{k}": F.when(cell < self.inner_cells, x).otherwise(y) for k, (x, y) in enumerate(zip(core, shell, strict=True))})
        return out.drop("_j", "_rank", "_s", "_q", "_a", "_r", "_b", "_c", "_ring", "_i")


def cylinder_nodes(spark: SparkSession, disc: Disc, outer: float, length: float, start_z: float, n_z: int, inner: float | None = None) -> DataFrame:
    """Nodes of a full cylinder of diameter outer; the core reaches to diameter inner, or to its share of the rings."""
    outer_radius = outer / 2
    core = inner / 2 if inner is not None else outer_radius * (disc.n_inner / (disc.n_inner + disc.n_outer))
    at, k = _index(F.col("vid"), disc.nodes)
    j, place, n = disc.ring(at)
    radius = F.when(j <= disc.n_inner, F.lit(core) * j / disc.n_inner).otherwise(F.lit(core) + F.lit(max(0.0, outer_radius - core)) * (j - disc.n_inner) / max(disc.n_outer, 1))
    theta = F.lit(2 * math.pi) * place / n
    edge = (k == 0) | (k == n_z) | (j == disc.n_inner + disc.n_outer)
    rows = spark.range(1, disc.nodes * (n_z + 1) + 1).withColumnRenamed("id", "vid")
    return rows.select("vid", (radius * F.cos(theta)).alias("x"), (radius * F.sin(theta)).alias("y"), (F.lit(float(start_z)) + F.lit(float(length)) * k / n_z).alias("z"), edge.cast("int").alias("knpr"))


def cylinder_cells(spark: SparkSession, disc: Disc, n_z: int) -> DataFrame:
    at, k = _index(F.col("cid"), disc.cells)
    rows = disc.corners(spark.range(1, disc.cells * n_z + 1).select(F.col("id").alias("cid"), at.alias("_cell"), k.alias("_layer")))
    return rows.select("cid", _hexes([F.col(f"c{i}") + F.col("_layer") * disc.nodes for i in range(4)], disc.nodes).alias("kvert"))


def parse_sections(raw: DataFrame) -> DataFrame:
    """(pos, lo, hi, mode) from a text of start:end:mode parts split by commas; `gap` tells of parts that don't join up."""
    part = F.posexplode(F.split(F.regexp_replace("raw", r"\s+", ""), ",")).alias("pos", "part")
    cut = F.split("part", ":")
    rows = raw.select(part).select("pos", cut[0].cast("double").alias("lo"), cut[1].cast("double").alias("hi"), F.lower(cut[2]).alias("mode"))
    before = F.lag("hi").over(Window.orderBy("pos"))  # a section list is a few rows
    return rows.withColumn("gap", F.coalesce(F.abs(F.col("lo") - before) > 1e-9, F.lit(False)) | (F.col("hi") <= F.col("lo")))


def snap_sections(sections: DataFrame, start_z: float, length: float, n_z: int) -> DataFrame:
    """Adds layer_lo and layer_hi, the nearest layers (ties to the even one), within the mesh."""
    dz = length / n_z

    def layer(c: str) -> Column:
        return F.least(F.lit(n_z), F.greatest(F.lit(0), F.bround((F.col(c) - start_z) / dz).cast("int")))

    return sections.withColumn("layer_lo", layer("lo")).withColumn("layer_hi", layer("hi"))


def hollow_layers(sections: DataFrame) -> DataFrame:
    """(layer): cell layers, from 0, without a core."""
    return sections.where("mode = 'hollow' AND layer_hi > layer_lo").select(F.explode(F.sequence("layer_lo", F.col("layer_hi") - 1)).alias("layer"))


def hybrid_cells(spark: SparkSession, disc: Disc, n_z: int, sections: DataFrame) -> DataFrame:
    """Cells of a cylinder whose core is missing in hollow layers; ids count the cells that are left."""
    every = cylinder_cells(spark, disc, n_z).withColumn("layer", F.floor((F.col("cid") - 1) / disc.cells).cast("int"))
    core = F.pmod(F.col("cid") - 1, F.lit(disc.cells)) < disc.inner_cells
    gone = F.broadcast(hollow_layers(sections).withColumn("hollow", F.lit(True)))  # one row for each layer at most
    return every.withColumn("core", core).join(gone, "layer", "left").where(~(F.coalesce("hollow", F.lit(False)) & F.col("core"))).select("cid", "kvert", "layer", "core")


def mark_hollow_rims(nodes: DataFrame, disc: Disc, sections: DataFrame) -> DataFrame:
    """knpr 1 also on the core's last ring at all levels that touch a hollow layer."""
    levels = hollow_layers(sections).select(F.explode(F.array(F.col("layer"), F.col("layer") + 1)).alias("level")).distinct()
    at, k = _index(F.col("vid"), disc.nodes)
    j, _, _ = disc.ring(at)
    rows = nodes.withColumn("level", k.cast("int")).withColumn("ring", j)
    marked = rows.join(F.broadcast(levels.withColumn("rim", F.lit(True))), "level", "left")
    on = F.coalesce("rim", F.lit(False)) & (F.col("ring") == disc.n_inner)
    return marked.select("vid", "x", "y", "z", F.when(on, 1).otherwise(F.col("knpr")).alias("knpr"))


def axis_mesh(spark: SparkSession, n, kind: str) -> DataFrame:
    """Index formulas of a tensor grid with n cells a side: kind vertex, cell, edge or face; ids count from 0.

    Edges run along x first, then y, then z; faces are normal to z first, then y, then x. Their rows don't come in the order of
    ids but in blocks of BLOCK nodes along x, with all axes of a block in turn. A column holds a node up to three times; these
    lie close together then, and compress to little more than one where the rows are written.
    """
    nx, ny, nz = n
    x1, y1, z1 = nx + 1, ny + 1, nz + 1
    low = (0, 1, x1, x1 + 1)

    def corners(rows: DataFrame, id_: Column, axis: Column, i: Column, j: Column, k: Column, steps) -> DataFrame:
        first = i + x1 * (j + y1 * k)
        return rows.select(id_.alias("id"), axis.alias("axis"), *[(first + s).cast("long").alias(f"v{m}") for m, s in enumerate(steps)])

    if kind in ("vertex", "cell"):
        sizes, steps = ((x1, y1, z1), (0,)) if kind == "vertex" else (n, (*low, *(s + x1 * y1 for s in low)))
        return corners(numbers(spark, 0, math.prod(sizes)), F.col("id"), F.lit(0), *_index(F.col("id") + 1, *sizes[:2]), steps)
    if kind == "edge":
        parts = [((nx, y1, z1), (0, 1)), ((x1, ny, z1), (0, x1)), ((x1, y1, nz), (0, x1 * y1))]
    elif kind == "face":
        parts = [((nx, ny, z1), low), ((nx, y1, nz), (0, 1, x1 * y1, x1 * y1 + 1)), ((x1, ny, nz), (0, x1, x1 * y1, x1 * y1 + x1))]
    else:
        raise ValueError(f"no kind {kind}")

    place, axis, j, k, block = _index(F.col("id") + 1, BLOCK, 3, y1, z1)
    places = numbers(spark, 0, math.ceil(x1 / BLOCK) * BLOCK * 3 * y1 * z1)
    places = places.select((block * BLOCK + place).alias("i"), axis.cast("int").alias("axis"), j.alias("j"), k.alias("k"))
    axis, i, j, k = (F.col(c) for c in ("axis", "i", "j", "k"))

    def of_axis(x, y, z) -> Column:
        return F.when(axis == 0, x).when(axis == 1, y).otherwise(z)

    bases = 0, math.prod(parts[0][0]), math.prod(parts[0][0]) + math.prod(parts[1][0])
    inside = of_axis(*[(i < a) & (j < b) & (k < c) for (a, b, c), _ in parts])
    id_ = of_axis(*[base + i + a * (j + b * k) for base, ((a, b, _), _) in zip(bases, parts, strict=True)])
    return corners(places.where(inside), id_, axis, i, j, k, [of_axis(*s) for s in zip(*[steps for _, steps in parts], strict=True)])


def pattern_meshes(patterns: DataFrame, template: DataFrame) -> DataFrame:
    """(pattern, local_vid, x, y, z, knpr): a template's nodes for each 8-bit pattern, whose bits mark the first eight."""
    bit = F.when(F.col("local_vid") <= 8, F.substring("pattern", F.col("local_vid").cast("int"), F.lit(1)).cast("int")).otherwise(0)
    rows = F.array(*[F.struct(F.lit(r["local_vid"]).alias("local_vid"), *[F.lit(r[c]).alias(c) for c in "xyz"]) for r in template.collect()])  # a template has 64 nodes at most
    return patterns.select("pattern", F.inline(rows)).withColumn("knpr", bit)
