"""Topology of box meshes from row numbers: what joins give on any mesh, without a shuffle of cells, faces or nodes.

A box of n = (nx, ny, nz) cells is the mesh of `generate.box_nodes` and `box_cells`. A neighbour, a face or an edge of a cell is known
by the cell's place, so each table here has as many rows as the result needs and is made where it is read. Values that only some
cells have stay a table of these cells; `filled` gives the others theirs. A keep is a function of places (i, j, k), of columns and of
numpy arrays alike, that tells which cells are kept.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshloom.functions.vectors import HEX_FACES
from meshloom.operators import topology as T
from meshloom.operators.generate import TASK_ROWS, _index, numbers
from meshloom.operators.refine import CORNERS
from meshloom.sources.shared import written

Keep = Callable
#: Cells along x that lie in a block of rows of `by_blocks`.
BESIDE = 32
#: Rows of one entry of `filled`, and rows whose doubles are added before their sums are.
BLOCK, ADDED = 1 << 8, 1 << 16
#: Cells that a task labels at once, at least a layer; and layers that a slab may end earlier, where fewer components go on.
SLAB, CUTS = 1 << 22, 4
#: Of each face of a cell, the axis it is normal to and whether it is on the far side.
SIDES = ((2, 0), (2, 1), (1, 0), (0, 1), (1, 1), (0, 0))


def place(id_: Column | str, n) -> list[Column]:
    """(i, j, k) of a cell; of a node, if n is one more each."""
    return _index(F.col(id_) if isinstance(id_, str) else id_, n[0], n[1])


def node(i, j, k, n):
    return i + (n[0] + 1) * (j + (n[1] + 1) * k) + 1


def cell(i, j, k, n):
    return i + n[0] * (j + n[1] * k) + 1


def corner_steps(n) -> list[int]:
    """How much greater the ids of a cell's corners are than its first one's."""
    return [a + (n[0] + 1) * (b + (n[1] + 1) * c) for a, b, c in CORNERS]


def on_side(lf: int, at, n) -> Column:
    axis, far = SIDES[lf - 1]
    return at[axis] == (n[axis] - 1 if far else 0)


def boundary_faces(spark: SparkSession, n, start=None, lengths=None, sides=range(1, 7)) -> DataFrame:
    """(cid, lf, nodes) of the faces that one cell has, on all sides or some; with start and lengths also p, their corners, and
    owned, how many nodes of its side the face has and none before it on that side."""
    out, steps = None, corner_steps(n)
    for lf in sides:
        axis, far = SIDES[lf - 1]
        free = [a for a in range(3) if a != axis]
        first, second = _index(F.col("id") + 1, n[free[0]])
        at = [None] * 3
        at[axis], at[free[0]], at[free[1]] = F.lit((n[axis] - 1 if far else 0)).cast("long"), first, second
        corners = HEX_FACES[lf - 1]
        rows = numbers(spark, 0, n[free[0]] * n[free[1]]).select(*[c.cast("long").alias(f"_{a}") for a, c in zip("ijk", at, strict=True)])
        at = [F.col(f"_{a}") for a in "ijk"]
        columns = [cell(*at, n).alias("cid"), F.lit(lf).alias("lf"), F.array(*[node(*at, n) + steps[c] for c in corners]).alias("nodes")]
        if start is not None:
            columns.append(F.array(*[F.struct(*[x.alias(c) for c, x in zip("xyz", position([q + s for q, s in zip(at, CORNERS[c], strict=True)], start, lengths, n), strict=True)]) for c in corners]).alias("p"))
            columns.append(reduce(lambda p, q: p * q, [F.when(at[a] == n[a] - 1, 2).otherwise(1) for a in free]).alias("owned"))
        part = rows.select(*columns)
        out = part if out is None else out.union(part)
    return out


def position(at, start, lengths, n) -> list[Column]:
    """x, y, z of a node, as `generate.box_nodes` gives them."""
    return [F.lit(float(s)) + F.lit(float(length)) * c / m for s, length, c, m in zip(start, lengths, at, n, strict=True)]


def added(rows: DataFrame, values: list[str], id_: str, *by: str, least: str | None = None) -> DataFrame:
    """(by.., n and sums of values, the least of another column), by sums of ADDED ids each, so that long sums of equal values keep their last places."""
    sums, low = [F.sum(v).alias(v) for v in values], [F.min(least).alias(least)] if least else []
    parts = rows.groupBy(*by, F.floor(F.col(id_) / ADDED).alias("_part")).agg(F.count(F.lit(1)).alias("n"), *sums, *low)
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), *sums, *low)


def box_corners(spark: SparkSession, start, lengths, n) -> tuple[DataFrame, list[tuple[Column, ...]]]:
    """Rows (cid, _i, _j, _k) and the places of the eight corners of each."""
    rows = numbers(spark, 1, math.prod(n) + 1).toDF("cid").select("cid", *[c.alias(f"_{a}") for a, c in zip("ijk", place("cid", n), strict=True)])
    ends = [F.col(f"_{a}") for a in "ijk"]
    low, high = position(ends, start, lengths, n), position([e + 1 for e in ends], start, lengths, n)
    rows = rows.select("cid", *[p.alias(f"{s}_{c}") for s, v in (("lo", low), ("hi", high)) for c, p in zip("xyz", v, strict=True)])
    return rows, [tuple(F.col(f"{'hi' if on else 'lo'}_{c}") for on, c in zip(corner, "xyz", strict=True)) for corner in CORNERS]


def is_boundary_cell(spark: SparkSession, n) -> DataFrame:
    """(cid, boundary)."""
    at = place("cid", n)
    edge = reduce(lambda p, q: p | q, [(x == 0) | (x == m - 1) for x, m in zip(at, n, strict=True)])
    return numbers(spark, 1, math.prod(n) + 1).toDF("cid").select("cid", edge.alias("boundary"))


def by_blocks(spark: SparkSession, n, times: int) -> DataFrame:
    """Rows (_lo, _hi, _j, _k, _e): the cells _lo.._hi along x of each block of BESIDE, with each _e in 0..times-1; `beside` makes them rows.

    Columns of ids repeat whole stretches of a block that way, which take next to no space where rows are written.
    """
    wide = max(1, min(BESIDE, n[0]))
    j, k, block = _index(F.col("id") + 1, n[1], n[2])
    rows = numbers(spark, 0, math.ceil(n[0] / wide) * n[1] * n[2], wide * times)
    rows = rows.select((block * wide).alias("_lo"), F.least(block * wide + wide, F.lit(n[0])).alias("_end"), j.alias("_j"), k.alias("_k"))
    return rows.select("_lo", (F.col("_end") - 1).alias("_hi"), "_j", "_k", F.explode(F.array(*map(F.lit, range(times)))).alias("_e"))


def beside(blocks: DataFrame, *columns: str) -> DataFrame:
    """Rows (_i, columns) of blocks, one for each _i in _lo.._hi."""
    return blocks.where("_lo <= _hi").select(F.explode(F.sequence("_lo", "_hi")).alias("_i"), *columns)


def of_place(values, at: Column) -> Column:
    """The at-th of some numbers."""
    return F.get(F.array(*[F.lit(v) for v in values]), at)


def adjacency(spark: SparkSession, n) -> DataFrame:
    """(cid, lf, nbr): the cell behind each face of each cell, null on the boundary."""
    step, e, zero = (1, n[0], n[0] * n[1]), F.col("_e"), F.lit(0).cast("long")
    # of a block's cells only one may have no cell behind its left or right face, and all or none behind another
    outer = reduce(lambda p, q: p | q, [(e == lf - 1) & on_side(lf, [None, F.col("_j"), F.col("_k")], n) for lf in (1, 2, 3, 5)])
    blocks = by_blocks(spark, n, 6).withColumns({"_first": cell(zero, F.col("_j"), F.col("_k"), n), "lf": e + 1, "_step": of_place([step[axis] if far else -step[axis] for axis, far in SIDES], e)})
    blocks = blocks.withColumn("_bare", F.when(outer, -1).when(e == 3, n[0] - 1).when(e == 5, 0).otherwise(-2))
    rows = beside(blocks, "_first", "lf", "_step", "_bare").select((F.col("_first") + F.col("_i")).alias("cid"), "lf", "_step", ((F.col("_bare") == -1) | (F.col("_bare") == F.col("_i"))).alias("_outer"))
    return rows.select("cid", "lf", F.when(~F.col("_outer"), F.col("cid") + F.col("_step")).alias("nbr"))


def span(cells: DataFrame, n) -> DataFrame:
    """Rows of cells (cid, ..) with nbr, for each cell that shares a node with theirs."""
    rows = cells.withColumns({f"_{a}": c.cast("long") for a, c in zip("ijk", place("cid", n), strict=True)})
    for a, m in zip("kji", reversed(n), strict=True):
        rows = rows.withColumn(f"_n{a}", F.explode(F.sequence(F.greatest(F.col(f"_{a}") - 1, F.lit(0)), F.least(F.col(f"_{a}") + 1, F.lit(m - 1)))))
    return rows.select(*cells.columns, cell(*[F.col(f"_n{a}") for a in "ijk"], n).alias("nbr")).where("nbr <> cid")


def spans(spark: SparkSession, n) -> DataFrame:
    """(cid, nbr): `span` of all cells, by blocks."""
    e, j, k = F.col("_e"), F.col("_j"), F.col("_k")
    blocks = by_blocks(spark, n, 27).where(e != 13).withColumns({f"_d{a}": of_place([t // 3**p % 3 - 1 for t in range(27)], e) for p, a in enumerate("ijk")})
    di, dj, dk = (F.col(f"_d{a}") for a in "ijk")
    blocks = blocks.where((j + dj).between(0, n[1] - 1) & (k + dk).between(0, n[2] - 1))
    blocks = blocks.select(
        F.greatest("_lo", -di.cast("long")).alias("_lo"),
        F.least("_hi", n[0] - 1 - di.cast("long")).alias("_hi"),
        cell(F.lit(0), j, k, n).alias("_first"),
        cell(di, j + dj, k + dk, n).alias("_near"),
    )
    return beside(blocks, "_first", "_near").select((F.col("_first") + F.col("_i")).alias("cid"), (F.col("_near") + F.col("_i")).alias("nbr"))


def _edge_ends(n) -> list[list[int]]:
    """How much greater the lesser and the greater node id of each edge of a cell are than its first one's."""
    steps = corner_steps(n)
    return [list(ends) for ends in zip(*[sorted((steps[p], steps[q])) for p, q in T.HEX_EDGES], strict=True)]


def cell_edges(spark: SparkSession, n) -> DataFrame:
    """(cid, le, a, b) with a < b: the twelve edges of each cell, by blocks."""
    e, j, k = F.col("_e"), F.col("_j"), F.col("_k")
    blocks = by_blocks(spark, n, 12).select("_lo", "_hi", (e + 1).alias("le"), cell(F.lit(0), j, k, n).alias("_cid"), *[(node(F.lit(0), j, k, n) + of_place(ends, e)).alias(f"_{c}") for c, ends in zip("ab", _edge_ends(n), strict=True)])
    firsts = {"cid": "_cid", "a": "_a", "b": "_b"}
    return beside(blocks, "le", *firsts.values()).select("le", *[(F.col(c) + F.col("_i")).alias(name) for name, c in firsts.items()]).select("cid", "le", "a", "b")


def edge_table(spark: SparkSession, n) -> DataFrame:
    """(eid, a, b): distinct edges, numbered by their first cell and place in it, by blocks of their first cells."""
    nx, ny, e, i, j, k = n[0], n[1], *(F.col(f"_{a}") for a in "eijk")
    # a cell is an edge's first if no cell below it in the other two directions has the edge as well: its place among the
    # cell's own, or 0, by whether i, j and k are 0
    places = []
    for i0, j0, k0 in itertools.product((False, True), repeat=3):
        first = (j0 and k0, k0, k0, i0 and k0, j0, True, True, i0, i0 and j0, j0, True, i0)
        places.append([sum(first[: t + 1]) if own else 0 for t, own in enumerate(first)])
    start = F.when(j == 0, 24).otherwise(0) + F.when(k == 0, 12).otherwise(0) + e
    blocks = by_blocks(spark, n, 12).withColumns({"_left": of_place(sum(places[4:], []), start), "_place": of_place(sum(places[:4], []), start)})
    blocks = blocks.withColumn("_hi", F.when(F.col("_place") > 0, F.col("_hi")).when((F.col("_lo") == 0) & (F.col("_left") > 0), F.lit(0)).otherwise(F.lit(-1)))
    blocks = blocks.withColumns({f"_{c}": node(F.lit(0), j, k, n) + of_place(ends, e) for c, ends in zip("ab", _edge_ends(n), strict=True)})
    blocks = blocks.withColumn("_row", j + ny * k)
    rows = beside(blocks, "_j", "_k", "_place", "_left", "_a", "_b", "_row").withColumn("_before", i + nx * F.col("_row"))
    before, rowed = F.col("_before"), F.col("_row") + F.when(i > 0, 1).otherwise(0)  # cells, and rows of cells begun, before one
    layered = k + F.when((i > 0) | (j > 0), 1).otherwise(0)
    counts = 3 * before + F.least(before, F.lit(nx)) + 2 * F.least(before, F.lit(nx * ny)) + F.least(rowed, F.lit(ny)) + 2 * rowed + layered
    counts = counts + 2 * (k * nx + F.least(F.lit(nx), i + nx * j)) + F.when(i == 0, F.col("_left")).otherwise(F.col("_place"))
    return rows.select(counts.cast("long").alias("eid"), *[(F.col(f"_{c}") + i).alias(c) for c in "ab"])


def min_edge(spark: SparkSession, start, lengths, n) -> DataFrame:
    """(min_edge): the shortest edge of positive length, of those along each axis."""
    parts = []
    for axis in range(3):
        ends = [position([F.col("id") + s] * 3, start, lengths, n)[axis] for s in (0, 1)]
        parts.append(spark.range(n[axis]).select(F.abs(ends[1] - ends[0]).alias("l")))
    return reduce(lambda p, q: p.union(q), parts).where("l > 0").agg(F.min("l").alias("min_edge"))


def umbrella_step(spark: SparkSession, start, lengths, n, weight: Callable[[Column], Column]) -> DataFrame:
    """(vid, x, y, z): `deform.umbrella_step` of the box's nodes, with a weight of their ids; neighbours are added in the order of ids."""
    n1 = tuple(m + 1 for m in n)
    rows = numbers(spark, 1, math.prod(n1) + 1).toDF("vid").select("vid", *[c.alias(f"_{a}") for a, c in zip("ijk", place("vid", n1), strict=True)])
    at, step = [F.col(f"_{a}") for a in "ijk"], (1, n1[0], n1[0] * n1[1])
    sums = {c: F.lit(0.0) for c in "wxyz"}
    # cells with an edge: two for each direction across it, one where that ends
    wide = [F.when((x == 0) | (x == m), 1).otherwise(2) for x, m in zip(at, n, strict=True)]
    rows = rows.select("vid", *[f"_{a}" for a in "ijk"], *[w.alias(f"_w{a}") for a, w in enumerate(wide)])
    order = [(2, -1), (1, -1), (0, -1), (0, 1), (1, 1), (2, 1)]
    for axis, way in order:
        cells = reduce(lambda p, q: p * q, [F.col(f"_w{a}") for a in range(3) if a != axis])
        there = at[axis] > 0 if way < 0 else at[axis] < n[axis]
        rows = rows.withColumn(f"_e{axis}{way}", F.when(there, cells * weight(F.col("vid") + way * step[axis])).otherwise(F.lit(0.0)))
        p = position([x + (way if a == axis else 0) for a, x in enumerate(at)], start, lengths, n)
        for c, value in zip("wxyz", (F.lit(1.0), *p), strict=True):
            sums[c] = sums[c] + F.col(f"_e{axis}{way}") * value
    total = rows.select("vid", *[s.alias(c) for c, s in sums.items()]).where("w > 0")
    return total.select("vid", *[(F.col(c) / F.col("w")).alias(c) for c in "xyz"])


def filled(spark: SparkSession, total: int, some: DataFrame, value: Column, otherwise: Column, name: str) -> DataFrame:
    """(id, name) of all ids 1..total: value where some (id, ..), with ids once at most, has the id, and otherwise the rest's.

    Ids go in blocks; only blocks are joined, so what is shuffled grows with some and by one number for BLOCK ids.
    """
    at = F.col("id") - 1
    known = some.select(F.floor(at / BLOCK).alias("_block"), F.struct(F.pmod(at, F.lit(BLOCK)).cast("int").alias("k"), value.alias("v")).alias("_e"))
    known = known.groupBy("_block").agg(F.map_from_entries(F.collect_list("_e")).alias("_known"))  # BLOCK entries at most
    blocks, parts = spark.range((total + BLOCK - 1) // BLOCK).toDF("_block"), math.ceil(total / TASK_ROWS)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        blocks = blocks.repartition(parts, "_block")
    blocks = blocks.join(known, "_block", "left")
    first = F.col("_block") * BLOCK + 1
    rows = blocks.select("_known", F.explode(F.sequence(first, F.least(first + BLOCK - 1, F.lit(total)))).alias("id"))
    return rows.select("id", F.coalesce(F.element_at("_known", F.pmod(at, F.lit(BLOCK)).cast("int")), otherwise).alias(name))


def smooth_levels(marks: DataFrame, n, top: int) -> DataFrame:
    """(cid, level) of cells above level 0: `refine.smooth_levels` of marks (cid, level) that only marked cells have."""
    now = marks.select("cid", "level").where("level > 0")
    for level in range(top, 1, -1):
        lifted = span(now.where(F.col("level") == level).select("cid"), n).select(F.col("nbr").alias("cid"), F.lit(level - 1).alias("level"))
        now = now.union(lifted.distinct()).groupBy("cid").agg(F.max("level").alias("level"))
    return now


def corners_of(cells: DataFrame, n) -> DataFrame:
    """Rows of cells (cid, ..) with vid, for each corner."""
    first = node(*place("cid", n), n).alias("_first")
    return cells.select(*cells.columns, first).select(*cells.columns, F.explode(F.array(*[F.col("_first") + s for s in corner_steps(n)])).alias("vid"))


def vertex_means(spark: SparkSession, values: DataFrame, n) -> DataFrame:
    """(vid, value): the mean of a value over the cells around each node; cells that values (cid, value) lacks have 0."""
    n1 = tuple(m + 1 for m in n)
    sums = corners_of(values, n).groupBy(F.col("vid").alias("id")).agg(F.sum("value").alias("value"))
    around = reduce(lambda p, q: p * q, [F.when((x == 0) | (x == m), 1).otherwise(2) for x, m in zip(place("id", n1), n, strict=True)])
    return filled(spark, math.prod(n1), sums, F.col("value"), F.lit(0.0), "value").select(F.col("id").alias("vid"), (F.col("value") / around).alias("value"))


def _kept(keep: Keep, n, lo: int, hi: int) -> np.ndarray:
    """Which cells of layers lo..hi-1 are kept, by (layer, row, place); none outside of the box."""
    k, j, i = np.meshgrid(np.arange(lo, hi), np.arange(n[1]), np.arange(n[0]), indexing="ij", sparse=True)
    inner = (k >= 0) & (k < n[2])
    return np.broadcast_to(keep(i, j, k) & inner, (hi - lo, n[1], n[0]))


def _used(keep: Keep, n, k: int) -> np.ndarray:
    """Which nodes of layer k kept cells have, by (row, place)."""
    flat = np.pad(_kept(keep, n, k - 1, k + 1).any(axis=0), 1)
    return flat[:-1, :-1] | flat[1:, :-1] | flat[:-1, 1:] | flat[1:, 1:]


def _layers(spark: SparkSession, n, keep: Keep) -> DataFrame:
    """(k, node_base, cell_base, upper_base): kept cells and their nodes in layers before each; upper_base is the next layer's node_base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column(0).to_pylist()
            nodes, cells = [int(_used(keep, n, k).sum()) for k in ks], [int(_kept(keep, n, k, k + 1).sum()) for k in ks]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(cells, pa.int64())], names=["k", "nodes", "cells"])

    counts = written(spark.range(n[2] + 1).toDF("k").mapInArrow(run, "k long, nodes long, cells long"), "layers")
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # a row for each layer
    bases = counts.select("k", "nodes", *[F.coalesce(F.sum(f"{c}s").over(before), F.lit(0)).alias(f"{c}_base") for c in ("node", "cell")])
    # back to as many tasks as the layers have work for, as the window ran in one
    spread = max(spark.sparkContext.defaultParallelism, math.ceil(math.prod(n) / SLAB))
    return bases.select("k", "node_base", "cell_base", (F.col("node_base") + F.col("nodes")).alias("upper_base")).repartition(spread, "k")


def kept_nodes(spark: SparkSession, n, keep: Keep) -> DataFrame:
    """(vid, old): the nodes of kept cells, numbered anew in the order of their old ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, base in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                old = np.flatnonzero(_used(keep, n, k).ravel()) + (n[0] + 1) * (n[1] + 1) * k + 1
                yield pa.RecordBatch.from_arrays([pa.array(base + 1 + np.arange(len(old))), pa.array(old)], names=["vid", "old"])

    return _layers(spark, n, keep).mapInArrow(run, "vid long, old long")


def kept_cells(spark: SparkSession, n, keep: Keep) -> DataFrame:
    """(cid, v1..v8): kept cells with the ids of `kept_nodes`, numbered anew in the order of their old ids."""
    names = ["cid", *[f"v{c + 1}" for c in range(8)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, low, first, high in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if k == n[2]:
                    continue
                ids = [base + np.cumsum(_used(keep, n, k + c).ravel()).reshape(n[1] + 1, n[0] + 1) for c, base in ((0, low), (1, high))]
                j, i = np.nonzero(_kept(keep, n, k, k + 1)[0])
                columns = [first + 1 + np.arange(len(i)), *[ids[c][j + b, i + a] for a, b, c in CORNERS]]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    return _layers(spark, n, keep).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def labels(kept: np.ndarray) -> np.ndarray:
    """Of a box of cells, the place of the first cell that each kept one reaches across faces; runs along x are one from the start."""
    depth, rows, width = kept.shape
    begins = kept.copy()
    begins[:, :, 1:] &= ~kept[:, :, :-1]
    run = np.cumsum(begins.ravel()).reshape(kept.shape) - 1
    label = np.arange(run[-1, -1, -1] + 1 if kept.size else 0)
    pairs = []
    for axis in (0, 1):
        lo, hi = (slice(None, -1), slice(1, None))
        a, b = (tuple(s if x == axis else slice(None) for x in range(3)) for s in (lo, hi))
        both = kept[a] & kept[b]
        new = both.copy()  # two runs meet along a stretch: its first cell tells
        new[:, :, 1:] &= ~both[:, :, :-1]
        pairs.append(np.stack([run[a][new], run[b][new]]))
    a, b = np.concatenate(pairs, axis=1)
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return np.flatnonzero(begins)[label][run] if len(label) else np.zeros(kept.shape, np.int64)


def _touching(keep: Keep, n, k: int) -> np.ndarray:
    """Which kept cells of layer k have a kept cell below, by (row, place)."""
    return _kept(keep, n, k - 1, k + 1).all(axis=0)


def _cut(keep: Keep, n, deep: int, s: int) -> int:
    """The first layer of slab s: of the last CUTS layers up to s * deep, that with the fewest cells on cells below."""
    if s * deep >= n[2]:
        return n[2]
    return min(range(s * deep, max(s * deep - CUTS, (s - 1) * deep), -1), key=lambda k: _touching(keep, n, k).sum()) if s else 0


def component_sizes(spark: SparkSession, n, keep: Keep, slab: int = SLAB) -> DataFrame:
    """(component, n): kept cells joined by faces, labelled by their least cell.

    Slabs of layers are labelled one by one, each with the next one's first layer. In that layer, cells that are joined within it are
    in one component on both sides, so their least cell links the slabs' components, if one of them lies on a kept cell; only these are joined.
    """
    layer = n[0] * n[1]
    deep = max(1, slab // layer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                lo, hi = _cut(keep, n, deep, s), _cut(keep, n, deep, s + 1)
                kept = _kept(keep, n, lo, min(hi + 1, n[2]))
                base = lo * layer + 1
                found = labels(kept)
                links = [np.zeros((0, 2), np.int64)]
                for k in {lo, hi} - {0, n[2]}:
                    touching = _touching(keep, n, k)
                    if touching.any():
                        names = labels(kept[k - lo : k - lo + 1])[0][touching] + k * layer + 1
                        links.append(np.stack([found[k - lo][touching] + base, names], axis=1))
                links = np.unique(np.concatenate(links), axis=0)
                sizes = np.bincount(found[: hi - lo][kept[: hi - lo]])
                roots = np.flatnonzero(sizes)
                sizes, roots = sizes[roots], roots + base
                open_ = np.isin(roots, links[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([roots, links[:, 0]])), pa.array(np.concatenate([sizes, np.zeros(len(links), np.int64)])), pa.array(np.concatenate([np.where(open_, 0, -1), links[:, 1]]))],
                    names=["root", "n", "link"],
                )

    slabs = math.ceil(n[2] / deep)
    parts = written(spark.range(0, slabs, 1, min(slabs, 1 << 14)).mapInArrow(run, "root long, n long, link long"), "slabs")
    links = parts.where("link > 0").select(F.col("root").alias("a"), F.col("link").alias("b"))
    ids = links.select(F.col("a").alias("id")).union(links.select("b"))
    joined = parts.where("link = 0").join(T.components(ids, links).withColumnRenamed("id", "root"), "root").groupBy("component").agg(F.sum("n").alias("n"))
    return parts.where("link = -1").select(F.col("root").alias("component"), "n").union(joined)
