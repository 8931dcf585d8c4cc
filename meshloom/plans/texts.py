"""Queries of text formats over lines from the tables, and whole runs on generated solids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators import cases as C
from meshloom.operators import generate as G
from meshloom.plans.mesh import table
from meshloom.plans.surfaces import box_surface
from meshloom.sources import text as X

#: Lines of a settings file, one for each supplier, and of a summary, one for each part: expressions for Spark and SQL alike.
SETTINGS = """CASE s_suppkey % 6 WHEN 0 THEN concat('[Group_', s_nationkey, ']') WHEN 1 THEN concat('Key_', s_suppkey, ' = ', s_nationkey, ' # a note')
  WHEN 2 THEN '; nothing = here' WHEN 3 THEN '' WHEN 4 THEN concat('  MODE=Kind_', s_nationkey, ' and more ') ELSE 'plain words' END"""
SUMMARY = """CASE p_partkey % 5 WHEN 0 THEN concat('bin ', p_partkey % 9, ' : ', p_size, '.5 %') WHEN 1 THEN concat(' bin ', p_partkey, ' = ', p_size, '%  of all')
  WHEN 2 THEN 'COUNT histogram' WHEN 3 THEN concat('size: ', p_size) ELSE concat('share = ', p_size, '.25%') END"""


def lines_of(spark: SparkSession, sf_dir: str, name: str, key: str, value: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).cast("long").alias("n"), F.expr(value).alias("value"))


def slab(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """A slab of 10 x 200 x 200, its wide sides of n x n squares."""
    from meshloom.operators import topology as T

    nodes, cells = G.box_nodes(spark, (-5, -100, -100), (10, 200, 200), (1, n, n)), G.box_cells(spark, (1, n, n))
    quads = T.boundary_faces(cells).select(((F.col("cid") * 6 + F.col("lf")) * 2).alias("f"), "nodes", "lf")
    v = [F.col("nodes")[k] for k in range(4)]

    def half(i: int, a: int, b: int, c: int):
        turned = F.when(F.col("lf") == 1, F.array(v[c], v[b], v[a])).otherwise(F.array(v[a], v[b], v[c]))  # the lower faces of cells run the other way
        return F.struct((F.col("f") + i).alias("fid"), turned.alias("v"))

    return nodes.select("vid", "x", "y", "z"), quads.select(F.inline(F.array(half(0, 0, 1, 2), half(1, 0, 2, 3))))


def min_gap_slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest gap of a slab, its thickness; its squares follow the number of regions."""
    found, _ = C.find_min_gap(*slab(spark, 2 * table(spark, sf_dir, "region").count()))
    return spark.createDataFrame([(found.face, round(found.raw, 6), round(found.adjusted, 6), found.min_bin, found.max_bin, found.span, round(found.coarse, 6))], "face long, raw double, adjusted double, min_bin int, max_bin int, span int, coarse double")


def cleaned_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.operators import surface as S

    n = (6, 6, 6)
    nodes, cells = G.box_nodes(spark, (-1.2, -1.2, -1.2), (2.4, 2.4, 2.4), n), G.box_cells(spark, n)
    new_nodes, new_cells, _ = C.clean(nodes, cells, S.corners(*box_surface(spark)))
    k = F.lit(1)
    return new_nodes.agg(F.count(k).alias("n_nodes"), F.sum("knpr").alias("n_boundary")).withColumn("k", k).join(new_cells.agg(F.count(k).alias("n_cells")).withColumn("k", k), "k").drop("k")


def monitored_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.operators import surface as S

    n = (3, 3, 3)
    nodes, cells = G.box_nodes(spark, (-0.7, -0.7, -0.7), (1.4, 1.4, 1.4), n), G.box_cells(spark, n)
    sizes = spark.range(12).select(F.col("id").alias("fid"), (1.0 + F.col("id") / 12).alias("mis"))
    return C.monitor(nodes, cells, S.corners(*box_surface(spark)), sizes, 1.0, 0.5).select("cid", F.round("value", 6).alias("value"))


def tube(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The surface of a hollow cylinder of radii 5 and 2 along z, moved by (1, -2), as two triangles for each boundary face."""
    from meshloom.operators import topology as T

    nodes, cells = G.annulus_nodes(spark, 10.0, 4.0, 20.0, 0.0, (36, 1, 2)), G.annulus_cells(spark, (36, 1, 2))
    quads = T.boundary_faces(cells).select(((F.col("cid") * 6 + F.col("lf")) * 2).alias("f"), "nodes", "lf")
    flip = F.col("lf").isin(1)  # the lower faces of cells run the other way

    def half(i: int, a: int, b: int, c: int):
        v = [F.col("nodes")[k] for k in (a, b, c)]
        return F.struct((F.col("f") + i).alias("fid"), F.when(flip, F.array(v[2], v[1], v[0])).otherwise(F.array(*v)).alias("v"))

    sf = quads.select(F.inline(F.array(half(0, 0, 1, 2), half(1, 0, 2, 3))))
    return nodes.select("vid", (F.col("x") + 1).alias("x"), (F.col("y") - 2).alias("y"), "z"), sf


def round_tube(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshloom.operators.boundary import Inflow
    from meshloom.operators.round import analyse

    g = analyse(*tube(spark), [Inflow(3, (0, 0, 1), (1, -2, 3.0)), Inflow(3, (0, 0, 1), (1, -2, 3.0))])
    return spark.createDataFrame([(round(g.center[0], 6) + 0.0, round(g.center[1], 6) + 0.0, g.aligned, round(g.outer_diameter, 6), g.kind, round(g.extrusion, 6), g.consistent, round(g.z_min, 6), round(g.z_max, 6))], "cx double, cy double, aligned boolean, outer double, kind string, extrusion double, consistent boolean, z_min double, z_max double")


def size_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of a base mesh for points from embeddings whose target size grows with their id; points beyond the box count at its side."""
    from meshloom.operators.sizefield import base_mesh
    from meshloom.plans.surfaces import points

    rows = points(spark, sf_dir)
    target = 0.02 + F.col("id") / 1000
    _, levels = base_mesh(rows.withColumns({f"t{c}": target for c in "xyz"}), (-1.0, -1.0, -1.0), (1.0, 1.0, 1.0))
    return levels


QUERIES = {
    "round_tube": round_tube,
    "size_field": size_field,
    "ini_carry_section": lambda s, d: X.settings(lines_of(s, d, "supplier", "s_suppkey", SETTINGS)),
    "parse_summary": lambda s, d: X.histogram_percents(lines_of(s, d, "part", "p_partkey", SUMMARY)),
    "cube_report": lambda s, d: C.report(*box_surface(s)),
    "min_gap_slab": min_gap_slab,
    "cleaned_cube": cleaned_cube,
    "monitored_cube": monitored_cube,
}


_FIELD = ", ".join(f"embedding[{i + 1}]::DOUBLE * 4 AS {c}" for i, c in enumerate("xyz"))
_CELL = ", ".join(f"least(2**d - 1, greatest(0, floor(({x} + 1) / (2.0 / 2**d)))) AS {i}" for x, i in zip("xyz", "ijk", strict=True))

SQL = {
    "round_tube": "SELECT 1.0::DOUBLE AS cx, -2.0::DOUBLE AS cy, false AS aligned, 10.0::DOUBLE AS outer, 'HollowCylinder' AS kind, 3.0::DOUBLE AS extrusion, true AS consistent, 3.0::DOUBLE AS z_min, 17.0::DOUBLE AS z_max",
    "size_field": f"""WITH RECURSIVE p AS (SELECT vec_id AS id, {_FIELD}, 0.02 + vec_id / 1000.0::DOUBLE AS t FROM embeddings), q AS (SELECT * FROM p),
      c AS (SELECT q.*, d, {_CELL} FROM q, range(12) r(d)),
      s AS (SELECT d, i, j, k, bool_or(t < 0.9::DOUBLE * (2.0::DOUBLE / 2**d)) AS s FROM c GROUP BY ALL),
      u AS (SELECT c.id, c.d, s.s FROM c JOIN s USING (d, i, j, k)),
      leaf AS (SELECT id, min(d) AS depth FROM u WHERE NOT s GROUP BY id),
      full_ AS (SELECT min(d) AS g FROM (SELECT r.d, (SELECT count(*) FROM s WHERE s.d = r.d AND s.s) < 8**r.d AS short FROM range(12) r(d)) WHERE short),
      b AS (SELECT greatest(g, 2) AS g, (2**greatest(g, 2))::BIGINT AS n FROM full_)
      SELECT (least(n, greatest(0, ceil((x + 1) / (2.0 / n) - 0.5))) + (n + 1) * (least(n, greatest(0, ceil((y + 1) / (2.0 / n) - 0.5))) + (n + 1) * least(n, greatest(0, ceil((z + 1) / (2.0 / n) - 0.5)))))::BIGINT AS vid,
        max(greatest(0, ceil((greatest(depth, 2) - g) * ln(2) / ln(3))))::INTEGER AS level FROM q JOIN leaf USING (id), b GROUP BY 1""",
    "ini_carry_section": f"""WITH t AS (SELECT s_suppkey::BIGINT AS n, {SETTINGS} AS value FROM supplier), c AS (SELECT n, trim(regexp_replace(value, '[#;].*$', '')) AS line FROM t),
      s AS (SELECT *, last_value(CASE WHEN line LIKE '[%' THEN lower(line[2:-2]) END IGNORE NULLS) OVER (ORDER BY n) AS section FROM c WHERE line <> '')
      SELECT n, section, lower(trim(split_part(line, '=', 1))) AS key, trim(substr(line, strpos(line, '=') + 1)) AS value FROM s WHERE line NOT LIKE '[%' AND line LIKE '%=%'""",
    "parse_summary": f"WITH t AS (SELECT p_partkey::BIGINT AS n, {SUMMARY} AS value FROM part) SELECT n, trim(regexp_extract(value, '^([^:=]*)[:=]', 1)) AS label, regexp_extract(value, '([0-9]+(\\.[0-9]+)?)\\s*%', 1)::DOUBLE AS pct FROM t WHERE value LIKE '%\\%%' ESCAPE '\\'",
}
