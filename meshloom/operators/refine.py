"""Marking of cells, smoothing of levels and refinement by templates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions import vectors as V
from meshloom.operators import topology as T

THRESHOLD = 1.25


def mark_by_threshold(cells: DataFrame, level: int, threshold: float = THRESHOLD) -> DataFrame:
    """(cid, level, value): values above the threshold raise the level, none is lowered."""
    return cells.withColumn("level", F.greatest("level", F.when(F.col("value") > threshold, level).otherwise(0)))


def smooth_levels(cells: DataFrame, marks: DataFrame, top: int) -> DataFrame:
    """(cid, level): cells beside one of level L (sharing a node) have at least L - 1, from the top level down to 1."""
    near, now = T.span(cells), marks.select("cid", "level")
    for level in range(top, 1, -1):
        lifted = near.join(now.where(F.col("level") == level).select(F.col("cid").alias("nbr")), "nbr").select("cid").distinct().withColumn("lift", F.lit(level - 1))
        now = now.join(lifted, "cid", "left").select("cid", F.greatest("level", F.coalesce("lift", F.lit(0))).alias("level"))
    return now


def level_distribution(marks: DataFrame, depth: int) -> DataFrame:
    """(level, n), levels held in 0..depth."""
    return marks.groupBy(F.least(F.greatest("level", F.lit(0)), F.lit(depth)).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def inflow_boost(cells: DataFrame, marks: DataFrame, inflow: DataFrame, depth: int) -> DataFrame:
    """(cid, level): boundary cells with an inflow face go up a level, to depth at most."""
    owners = inflow.select("cid").distinct().withColumn("_in", F.lit(1))
    edge = T.is_boundary_cell(cells).where("boundary").select("cid").withColumn("_b", F.lit(1))
    rows = marks.join(owners, "cid", "left").join(edge, "cid", "left")
    up = F.coalesce(F.col("_in") * F.col("_b"), F.lit(0))
    return rows.select("cid", F.when(up > 0, F.least(F.col("level") + up, F.lit(depth))).otherwise(F.col("level")).alias("level"))


def vertex_marks(cells: DataFrame, marks: DataFrame, level: int) -> DataFrame:
    """(vid): nodes of cells of this level or more."""
    return cells.join(marks.where(F.col("level") >= level), "cid", "left_semi").select(F.explode("kvert").alias("vid")).distinct()


#: The eight corners of a hexahedron as places of a cube; corner i is (s, t, u).
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))


def rotations() -> list[tuple[int, ...]]:
    """The 24 rotations of the cube as permutations of its corners, the identity first."""
    out = []
    number = {c: i for i, c in enumerate(CORNERS)}
    for axes in ((0, 1, 2), (1, 2, 0), (2, 0, 1), (0, 2, 1), (1, 0, 2), (2, 1, 0)):
        even = axes in ((0, 1, 2), (1, 2, 0), (2, 0, 1))
        for flips in range(8):
            flip = [(flips >> k) & 1 for k in range(3)]
            if (sum(flip) % 2 == 0) == even:
                out.append(tuple(number[tuple(c[a] ^ f for a, f in zip(axes, flip, strict=True))] for c in CORNERS))
    return out


def canonical_patterns(masks: DataFrame) -> DataFrame:
    """masks (pattern: string of 8 bits) with canonical, the rotation whose marked corners come first, and turn, its number.

    Corners count by the sum of the squares of their places; the first corner must be marked if any is.
    """
    turned = F.array(*[F.struct(F.concat(*[F.substring("pattern", p[i] + 1, 1) for i in range(8)]).alias("p"), F.lit(k).alias("k")) for k, p in enumerate(rotations())])
    first = F.filter(turned, lambda s: s["p"].startswith("1") | (s["p"] == "00000000"))
    scored = F.transform(first, lambda s: F.struct((-pattern_score(s["p"])).alias("s"), s["p"].alias("p"), (-s["k"]).alias("k")))
    return masks.withColumn("_best", F.array_max(scored)).withColumns({"canonical": F.col("_best.p"), "turn": -F.col("_best.k")}).drop("_best")


def pattern_score(pattern: Column) -> Column:
    total = F.lit(0)
    for i in range(8):
        total = total + F.substring(pattern, i + 1, 1).cast("int") * ((i + 1) ** 2)
    return total


def cell_patterns(cells: DataFrame, marked: DataFrame) -> DataFrame:
    """(cid, pattern): which corners of each cell are marked, as a string of bits."""
    at = cells.select("cid", F.posexplode("kvert").alias("pos", "vid")).join(marked.select("vid").withColumn("m", F.lit("1")), "vid", "left")
    bits = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("m", F.lit("0")).alias("m"))))
    return at.groupBy("cid").agg(F.array_join(F.transform(bits, lambda b: b["m"]), "").alias("pattern"))


def template_usage(patterns: DataFrame, known: list[str]) -> DataFrame:
    """(template, n): how often each canonical pattern occurs; those that aren't known count together as unknown."""
    name = F.when(F.col("canonical").isin(known), F.col("canonical")).otherwise("unknown")
    return canonical_patterns(patterns).groupBy(name.alias("template")).agg(F.count(F.lit(1)).alias("n"))


def thirds_template(spark: SparkSession) -> DataFrame:
    """(sub, s0..s7): the 27 equal parts of a cube, corners as numbers i + 4 * (j + 4 * k) of the 4 x 4 x 4 nodes."""
    i, j, k = (F.pmod(F.floor(F.col("sub") / 3**a), F.lit(3)) for a in range(3))
    at = [(i + a) + 4 * ((j + b) + 4 * (k + c)) for a, b, c in CORNERS]
    return spark.range(27).withColumnRenamed("id", "sub").select("sub", F.array(*at).alias("kloc"))


def refine_uniformly(nodes: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every cell cut into 27: new nodes and cells, without duplicate nodes.

    A new node is known by what it lies on: the old nodes that share in it and their weights, in the order of their ids. So
    neighbours find the same node by an equi-join, and no distance decides.
    """
    spark = nodes.sparkSession
    corners = T.corners_of(cells, nodes)
    s, t, u = (F.pmod(F.floor(F.col("loc") / 4**a), F.lit(4)) for a in range(3))
    rows = cells.join(corners, "cid").select("cid", "kvert", "p", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("loc"))

    def weight(c: tuple[int, int, int]) -> Column:
        parts = [x if on else 3 - x for x, on in zip((s, t, u), c, strict=True)]
        return parts[0] * parts[1] * parts[2]

    shares = F.array(*[F.struct(F.element_at("kvert", i + 1).alias("vid"), weight(c).cast("int").alias("w")) for i, c in enumerate(CORNERS)])
    key = F.array_sort(F.filter(shares, lambda x: x["w"] > 0))
    place = V.trilinear([V.field(F.col("p")[i]) for i in range(8)], *(2.0 * x / 3.0 - 1.0 for x in (s, t, u)))
    found = T.written(rows.select("cid", "loc", key.alias("key"), *[c.alias(n) for c, n in zip(place, "xyz", strict=True)]), "refined")
    first = found.groupBy("key").agg(F.min(F.struct("cid", "loc", "x", "y", "z")).alias("f"))
    numbered = T.written(T.dense_ids(first.select("key", "f.*"), ["cid", "loc"], "vid"), "numbered")
    at = found.select("cid", "loc", "key").join(numbered.select("key", "vid"), "key").select("cid", "loc", "vid")
    by_cell = at.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("loc", "vid"))), lambda x: x["vid"]).alias("ids"))  # 64 a cell
    parts = F.array(*[F.array(*[F.lit(int(v)) for v in r["kloc"]]) for r in thirds_template(spark).orderBy("sub").collect()])
    cut = by_cell.select("cid", "ids", F.posexplode(parts).alias("sub", "kloc"))
    out = cut.select(((F.col("cid") - 1) * 27 + F.col("sub") + 1).alias("cid"), F.transform("kloc", lambda v: F.element_at("ids", v.cast("int") + 1)).alias("kvert"))
    return numbered.select("vid", "x", "y", "z"), out


@dataclass(frozen=True)
class Template:
    """How a cell with a pattern of marked corners is cut: points in the reference cube [-1, 1]^3, and cells of eight of them."""

    pattern: str
    points: tuple[tuple[float, float, float], ...]
    cells: tuple[tuple[int, ...], ...]
    final: bool = True

    def weights(self) -> list[list[float]]:
        """Shares of the eight corners in each point."""
        return [[math.prod((1 + x if on else 1 - x) / 2 for x, on in zip(p, c, strict=True)) for c in CORNERS] for p in self.points]


def whole(pattern: str = "00000000") -> Template:
    """The template that leaves a cell as it is."""
    return Template(pattern, tuple(tuple(2.0 * x - 1 for x in c) for c in CORNERS), (tuple(range(8)),))


def thirds(pattern: str = "11111111") -> Template:
    """The template of 27 equal parts."""
    points = tuple(tuple(2 * x / 3 - 1 for x in (i, j, k)) for k in range(4) for j in range(4) for i in range(4))
    cells = tuple(tuple((i + a) + 4 * ((j + b) + 4 * (k + c)) for a, b, c in CORNERS) for k in range(3) for j in range(3) for i in range(3))
    return Template(pattern, points, cells)


def load_templates(spark: SparkSession, files: dict[str, str]) -> list[Template]:
    """Templates from .tri files by their pattern; one in a folder INT is not final, and its parts are to be cut once more."""
    from meshloom.sources.meshes import read_tri

    out = []
    for pattern, path in files.items():
        _, nodes, cells = read_tri(spark, path)
        points = tuple((r["x"], r["y"], r["z"]) for r in nodes.orderBy("vid").collect())  # 64 points at most
        out.append(Template(pattern, points, tuple(tuple(v - 1 for v in r["kvert"]) for r in cells.orderBy("cid").collect()), "/INT/" not in path))
    return out


def refine_by_templates(nodes: DataFrame, cells: DataFrame, marked: DataFrame, templates: list[Template]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New nodes and cells of a mesh whose marked nodes (vid) say how each cell is cut, and how often each pattern was unknown.

    A cell's pattern is turned to its canonical form, the template's points are taken through the turned corners, and points that
    rest on the same old nodes with the same shares are one: neighbours meet by an equi-join. Cells of unknown patterns stay whole.
    """
    spark = nodes.sparkSession
    known = [whole(), *(t for t in templates if t.pattern != "00000000")]
    turned = T.written(canonical_patterns(cell_patterns(cells, marked)), "patterns")
    name = F.when(F.col("canonical").isin([t.pattern for t in known]), F.col("canonical")).otherwise("00000000")
    turns = F.array(*[F.array(*[F.lit(i) for i in p]) for p in rotations()])
    placed = cells.select("cid", "kvert").join(turned.select("cid", name.alias("template"), turns[F.col("turn")].alias("perm")), "cid").join(T.corners_of(cells, nodes), "cid")
    ready = placed.select("cid", "template", F.transform("perm", lambda i: F.struct(F.element_at("kvert", i + 1).alias("vid"), F.element_at("p", i + 1).alias("at"))).alias("q"))
    points = spark.createDataFrame([(t.pattern, k, w) for t in known for k, w in enumerate(t.weights())], "template string, loc int, w array<double>")
    parts = spark.createDataFrame([(t.pattern, k, list(c)) for t in known for k, c in enumerate(t.cells)], "template string, sub int, kloc array<int>")
    rows = ready.join(F.broadcast(points), "template")  # a catalogue of a few dozen templates
    shares = F.zip_with("q", "w", lambda q, w: F.struct(q["vid"].alias("vid"), F.round(w * 1e6).cast("int").alias("w")))
    key = F.array_sort(F.filter(shares, lambda x: x["w"] > 0))

    def place(c: str) -> Column:
        return F.aggregate(F.zip_with("q", "w", lambda q, w: q["at"][c] * w), F.lit(0.0), lambda x, y: x + y).alias(c)

    found = T.written(rows.select("cid", "template", "loc", key.alias("key"), *[place(c) for c in "xyz"]), "refined")
    first = found.groupBy("key").agg(F.min(F.struct("cid", "loc", "x", "y", "z")).alias("f"))
    numbered = T.written(T.dense_ids(first.select("key", "f.*"), ["cid", "loc"], "vid"), "numbered")
    ids = found.select("cid", "template", "loc", "key").join(numbered.select("key", "vid"), "key").groupBy("cid", "template")
    by_cell = ids.agg(F.transform(F.array_sort(F.collect_list(F.struct("loc", "vid"))), lambda x: x["vid"]).alias("ids"))  # a template's points
    cut = by_cell.join(F.broadcast(parts), "template").select("cid", "sub", F.transform("kloc", lambda v: F.element_at("ids", v + 1)).alias("kvert"))
    new_cells = T.dense_ids(cut.withColumnsRenamed({"cid": "parent"}), ["parent", "sub"], "cid")
    unknown = turned.where(~F.col("canonical").isin([t.pattern for t in known])).groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))
    return numbered.select("vid", "x", "y", "z"), new_cells.select("cid", "kvert", "parent"), unknown
