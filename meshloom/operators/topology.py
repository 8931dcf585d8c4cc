"""Faces, edges, neighbours, components and renumbering of hexahedral and triangle meshes.

Cells are (cid, kvert array<long>), triangles (fid, v array<long>). A face is known by its sorted node ids, so one shuffle on that
key gives adjacency, the boundary and conflicts alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.vectors import HEX_EDGES, HEX_FACES
from meshloom.sources.shared import written


def corner(i: int) -> Column:
    return F.element_at("kvert", i + 1)


def faces(cells: DataFrame) -> DataFrame:
    """(cid, lf 1..6, nodes, key): key is the sorted nodes."""
    quads = F.array(*[F.array(*[corner(i) for i in face]) for face in HEX_FACES])
    out = cells.select("cid", F.posexplode(quads).alias("lf", "nodes"))
    return out.select("cid", (F.col("lf") + 1).alias("lf"), "nodes", F.array_sort("nodes").alias("key"))


def owners(cells: DataFrame) -> DataFrame:
    """(key, n, a, b): the cells at each face, as (cid, lf); b is null on the boundary, n over 2 is a conflict."""
    side = F.struct("cid", "lf", "nodes")
    return faces(cells).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(side).alias("a"), F.max(side).alias("z")).select("key", "n", "a", F.when(F.col("n") > 1, F.col("z")).alias("b"))


def adjacency(cells: DataFrame) -> DataFrame:
    """(cid, lf, nbr): the cell behind each face of each cell, null on the boundary; faces of over two cells have no neighbour."""
    pairs = owners(cells).select(F.when(F.col("n") <= 2, F.col("a")).alias("a"), F.when(F.col("n") == 2, F.col("b")).alias("b"), "n")
    both = F.array(F.struct(F.col("a.cid").alias("cid"), F.col("a.lf").alias("lf"), F.col("b.cid").alias("nbr")), F.struct(F.col("b.cid").alias("cid"), F.col("b.lf").alias("lf"), F.col("a.cid").alias("nbr")))
    return pairs.select(F.inline(both)).where("cid IS NOT NULL")


def conflicts(cells: DataFrame) -> DataFrame:
    """(key, n): faces of more than two cells."""
    return faces(cells).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2")


def boundary_faces(cells: DataFrame) -> DataFrame:
    """(cid, lf, nodes) of faces that one cell has."""
    return owners(cells).where("n = 1").select("a.cid", "a.lf", "a.nodes")


def boundary_nodes(cells: DataFrame) -> DataFrame:
    return boundary_faces(cells).select(F.explode("nodes").alias("vid")).distinct()


def recompute_knpr(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """nodes with knpr 1 on the boundary and 0 elsewhere."""
    marked = boundary_nodes(cells).withColumn("_b", F.lit(1))
    return nodes.drop("knpr").join(marked, "vid", "left").withColumn("knpr", F.coalesce("_b", F.lit(0))).drop("_b")


def is_boundary_cell(cells: DataFrame) -> DataFrame:
    """(cid, boundary): whether a cell has a face without neighbour."""
    return adjacency(cells).groupBy("cid").agg(F.bool_or(F.col("nbr").isNull()).alias("boundary"))


def corners_of(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cid, p array of 8 structs x, y, z), in the order of kvert: one shuffle of nodes and corners, and one back to cells."""
    at = cells.select("cid", F.posexplode("kvert").alias("pos", "vid"))
    found = at.join(nodes.select("vid", "x", "y", "z"), "vid")
    rows = found.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))).alias("p"))  # eight rows a cell
    return rows.select("cid", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), q["z"].alias("z"))).alias("p"))


def cell_edges(cells: DataFrame) -> DataFrame:
    """(cid, le, a, b) with a < b: the twelve edges of each cell."""
    pairs = F.array(*[F.struct(F.least(corner(i), corner(j)).alias("a"), F.greatest(corner(i), corner(j)).alias("b")) for i, j in HEX_EDGES])
    return cells.select("cid", F.posexplode(pairs).alias("le", "e")).select("cid", (F.col("le") + 1).alias("le"), "e.a", "e.b")


def edge_table(cells: DataFrame) -> DataFrame:
    """(eid, a, b): distinct edges, numbered by their first cell and place in it."""
    first = cell_edges(cells).groupBy("a", "b").agg(F.min(F.struct("cid", "le")).alias("first"))
    return dense_ids(first.select("a", "b", "first.cid", "first.le"), ["cid", "le"], "eid").select("eid", "a", "b")


def dense_ids(rows: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """Adds first, first + 1, ... in this order, which must be total.

    Rows are dealt into ranges of the order; ranges are counted, and numbers run within each range: no window over all rows.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranges")  # partition in the upper bits, place in the lower
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    numbered = dealt.withColumn("_part", part).join(F.broadcast(base.select("_part", "_base")), "_part")
    return numbered.withColumn(name, F.col("_base") + place + first).drop("_id", "_part", "_base")


def span(cells: DataFrame) -> DataFrame:
    """(cid, nbr): cells that share a node, each pair in both directions once."""
    at = cells.select("cid", F.explode("kvert").alias("vid"))
    return at.join(at.select(F.col("cid").alias("nbr"), "vid"), "vid").where("cid <> nbr").select("cid", "nbr").distinct()


def triangle_edges(triangles: DataFrame) -> DataFrame:
    """(fid, a, b): the three directed edges of each triangle."""
    v = [F.element_at("v", i + 1) for i in range(3)]
    edges = F.array(*[F.struct(v[i].alias("a"), v[(i + 1) % 3].alias("b")) for i in range(3)])
    return triangles.select("fid", F.inline(edges))


def triangle_neighbors(triangles: DataFrame) -> DataFrame:
    """(fid, nbr): triangles across each edge, by the edge that runs the other way."""
    edges = triangle_edges(triangles)
    return edges.join(edges.select(F.col("fid").alias("nbr"), F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).select("fid", "nbr")


def vertex_neighbors(triangles: DataFrame) -> DataFrame:
    """(fid, nbr): triangles that share a vertex, each pair in both directions once."""
    at = triangles.select("fid", F.explode("v").alias("vid"))
    return at.join(at.select(F.col("fid").alias("nbr"), "vid"), "vid").where("fid <> nbr").select("fid", "nbr").distinct()


def surface_summary(triangles: DataFrame) -> DataFrame:
    """(n_vertices, n_edges, n_faces, closed, consistent) of a triangle surface, in one row."""
    edges = triangle_edges(triangles)
    sides = edges.groupBy(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(-1)).alias("turn"))
    per_edge = sides.agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.bool_and(F.col("n") == 2), F.lit(False)).alias("closed"), F.coalesce(F.bool_and((F.col("n") != 2) | (F.col("turn") == 0)), F.lit(False)).alias("consistent"))
    per_face = triangles.select("fid", F.explode("v").alias("vid")).agg(F.count_distinct("vid").alias("n_vertices"), F.count_distinct("fid").alias("n_faces"))
    return per_face.withColumn("_k", F.lit(1)).join(per_edge.withColumn("_k", F.lit(1)), "_k").select("n_vertices", "n_edges", "n_faces", "closed", "consistent")


def components(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the least id that each id reaches along links (a, b).

    Every round hooks labels to the least label next to them and then jumps to labels' labels, so long chains halve.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    labels = written(ids.select("id").distinct().withColumn("l", F.col("id")), "labels")
    while True:
        tagged = both.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").where("la <> lb")
        hooks = written(tagged.groupBy("la").agg(F.min("lb").alias("m")).where("m < la").toDF("id", "m"), "hooks")
        if hooks.isEmpty():
            return labels.toDF("id", "component")
        up = written(labels.join(hooks, "id", "left").select("id", F.least("l", F.coalesce("m", "l")).alias("l")), "labels")
        for _ in range(2):
            up = up.join(up.toDF("l", "up"), "l").select("id", F.col("up").alias("l"))
        labels = written(up, "labels")


def component_sizes(cells: DataFrame) -> DataFrame:
    """(component, n): cells joined by faces, labelled by their least cell."""
    links = owners(cells).where("n = 2").select(F.col("a.cid").alias("a"), F.col("b.cid").alias("b"))
    return components(cells.select(F.col("cid").alias("id")), links).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def reduce_mesh(nodes: DataFrame, cells: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mesh of the cells in keep (cid): nodes that they use and cells, both numbered anew in the order of their old ids."""
    left = written(cells.join(keep.select("cid"), "cid", "left_semi"), "kept")
    used = left.select(F.explode("kvert").alias("vid")).distinct()
    ids = dense_ids(used, ["vid"], "new")
    out_nodes = nodes.join(ids, "vid").drop("vid").withColumnRenamed("new", "vid")
    at = left.select("cid", F.posexplode("kvert").alias("pos", "vid")).join(ids, "vid")
    kvert = at.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda q: q["new"]).alias("kvert"))
    out_cells = dense_ids(kvert, ["cid"], "new").withColumnRenamed("cid", "old_cid").withColumnRenamed("new", "cid")
    return out_nodes, out_cells


def min_edge(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """(min_edge): the shortest edge of positive length."""
    at = nodes.select("vid", "x", "y", "z")
    ends = cell_edges(cells).select("a", "b").distinct().join(at.toDF("a", "ax", "ay", "az"), "a").join(at.toDF("b", "bx", "by", "bz"), "b")
    length = F.sqrt(reduce(lambda p, q: p + q, [(F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"]))
    return ends.select(length.alias("l")).where("l > 0").agg(F.min("l").alias("min_edge"))


#: Half of the cells around one: each pair of neighbours once.
HALF = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]


def merge_points(nodes: DataFrame, tolerance: float) -> DataFrame:
    """(vid, into): the least id that nodes (vid, x, y, z) reach over steps of at most the tolerance in every coordinate.

    Nodes lie in cells as wide as the tolerance, so those of a cell are one, and are joined to their least as a star. Only nodes of
    neighbouring cells are compared. Nodes with a coordinate that is no finite number stay alone.
    """
    known = nodes.where(" AND ".join(f"abs({c}) < double('infinity')" for c in "xyz"))
    # of equal points, one is compared
    alike = known.groupBy("x", "y", "z").agg(F.min("vid").alias("first"))
    placed = alike.select("first", "x", "y", "z", *[F.floor(F.col(c) / tolerance).alias(f"_{c}") for c in "xyz"])
    placed = written(placed, "placed")
    cell = ["_x", "_y", "_z"]
    stars = placed.join(placed.groupBy(*cell).agg(F.min("first").alias("a")), cell).where("a <> first").select("a", F.col("first").alias("b"))
    near = placed.select("first", "x", "y", "z", F.explode(F.array(*[F.struct(*[(F.col(f"_{c}") + d).alias(f"_{c}") for c, d in zip("xyz", step, strict=True)]) for step in HALF])).alias("c"))
    near = near.select(F.col("first").alias("a"), *[F.col(c).alias(f"a_{c}") for c in "xyz"], "c._x", "c._y", "c._z")
    close = F.greatest(*[F.abs(F.col(f"a_{c}") - F.col(c)) for c in "xyz"]) <= tolerance
    links = stars.union(near.join(placed, cell).where(close).select("a", F.col("first").alias("b")))
    found = components(placed.select(F.col("first").alias("id")), written(links, "links")).select(F.col("id").alias("first"), F.col("component").alias("into"))
    merged = known.select("vid", "x", "y", "z").join(alike, ["x", "y", "z"]).join(found, "first").select("vid", "into")
    return nodes.select("vid").join(merged, "vid", "left").select("vid", F.coalesce("into", "vid").alias("into"))


def merge_mesh(nodes: DataFrame, cells: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Nodes and cells (cid, kvert) with merged points, ids as they were; of merged points, the least id's place stays."""
    merged = written(merge_points(nodes, tolerance), "merged")
    kept = nodes.join(merged.where("vid = into").select("vid"), "vid", "left_semi")
    at = cells.select("cid", F.posexplode("kvert").alias("k", "vid")).join(merged, "vid")
    moved = at.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "into"))), lambda e: e["into"]).alias("kvert"))
    return kept, cells.drop("kvert").join(moved, "cid")
