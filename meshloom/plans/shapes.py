"""Queries over polygons made from the tables: rectangles on whole numbers, and rings around shared middles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators import polygons as G
from meshloom.operators import topology as T
from meshloom.plans.mesh import rounded, table
from meshloom.plans.surfaces import component

#: How far rectangles spread, and how large they are; rings to a middle, and how far middles are apart.
SPREAD, LARGEST = 90, 40
RINGS, APART = 6, 20.0
#: Points are one within this; places are whole eighths, or a fourth of an eighth off, so no distance is near it by rounding.
MERGED = 0.15


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.floor(component(0) * SPREAD).cast("double"), F.floor(component(1) * SPREAD).cast("double")
    w, h = (1 + F.floor(F.abs(component(k)) * LARGEST) for k in (2, 3))
    corners = [F.struct((x + i * w).alias("x"), (y + j * h).alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(*corners).alias("p"))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RINGS rings around each of some middles, of three to six points, each well within the next."""
    place, rank = F.floor(F.col("vec_id") / RINGS), F.pmod("vec_id", F.lit(RINGS))
    n, r = 3 + F.pmod("vec_id", F.lit(4)), F.pow(F.lit(0.35), rank) * 8.0
    x, y = F.pmod(place, F.lit(9)) * APART, F.floor(place / 9) * APART
    angle = lambda k: component(0) + k * (2 * math.pi) / n
    points = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: F.struct((x + r * F.cos(angle(k))).alias("x"), (y + r * F.sin(angle(k))).alias("y")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), points.alias("p"))


def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(area, length, outer_less_holes) of the rectangles' union."""
    loops = G.loop_measures(G.union(rectangles(spark, sf_dir)))
    return loops.agg(F.sum("area").alias("area"), F.sum("length").alias("length"), F.sum(F.signum("area")).cast("long").alias("outer_less_holes"))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vid, into) of points from embeddings, among them equal ones, that lie within MERGED of each other."""
    place = [F.floor(component(k) * 40) / 8 + F.when(F.col("vec_id") % 3 == 0, F.lit(0.03125)).otherwise(0.0) for k in range(3)]
    return T.merge_points(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vid"), *[p.alias(c) for p, c in zip(place, "xyz", strict=True)]), MERGED)


QUERIES = {
    "merged_points": merged,
    "polygon_union": lambda s, d: rounded(union(s, d), "area", "length"),
    "polygon_nesting": lambda s, d: G.nesting(rings(s, d)),
    "ring_areas": lambda s, d: rounded(G.areas(rings(s, d)), "area"),
}

_CELLS = f"""r AS (SELECT floor(embedding[1]::DOUBLE * {SPREAD})::BIGINT AS x, floor(embedding[2]::DOUBLE * {SPREAD})::BIGINT AS y, 1 + floor(abs(embedding[3]::DOUBLE) * {LARGEST})::BIGINT AS w, 1 + floor(abs(embedding[4]::DOUBLE) * {LARGEST})::BIGINT AS h FROM embeddings),
a AS (SELECT y, h, x + unnest(range(w)) AS i FROM r), c AS (SELECT DISTINCT i, y + unnest(range(h)) AS j FROM a),
e AS (SELECT i, j, 0 AS d FROM c UNION ALL SELECT i, j + 1, 0 FROM c UNION ALL SELECT i, j, 1 FROM c UNION ALL SELECT i + 1, j, 1 FROM c), u AS (SELECT i, j, d, count(*) AS n FROM e GROUP BY ALL),
v AS (SELECT DISTINCT i + p AS i, j + q AS j FROM c, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) s(p, q))"""
_RINGS = f"""g AS (SELECT vec_id AS id, vec_id // {RINGS} AS place, vec_id % {RINGS} AS rank, 3 + vec_id % 4 AS n, embedding[1]::DOUBLE AS turn FROM embeddings),
t AS (SELECT id, place, rank, n, unnest(range(n)) AS k, pow(0.35::DOUBLE, rank) * 8 AS r, turn, (place % 9) * {APART}::DOUBLE AS x, (place // 9) * {APART}::DOUBLE AS y FROM g),
s AS (SELECT id, n, k, x + r * cos(turn + k * 2 * pi() / n) AS x, y + r * sin(turn + k * 2 * pi() / n) AS y FROM t)"""

SQL = {
    "merged_points": f"""WITH RECURSIVE p AS (SELECT vec_id AS id, {', '.join(f'floor(embedding[{i + 1}]::DOUBLE * 40) / 8 + CASE WHEN vec_id % 3 = 0 THEN 0.03125 ELSE 0 END AS {c}' for i, c in enumerate('xyz'))} FROM embeddings),
      l AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON {' AND '.join(f'abs(a.{c} - b.{c}) <= {MERGED}' for c in 'xyz')}),
      r(id, c) AS (SELECT id, id FROM p UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id WHERE r.c < l.b)
      SELECT id AS vid, min(c) AS "into" FROM r GROUP BY id""",
    # cells, sides and corners of whole-numbered squares: their alternating sum is parts less holes
    "polygon_union": f"WITH {_CELLS} SELECT (SELECT count(*) FROM c)::DOUBLE AS area, (SELECT count(*) FROM u WHERE n = 1)::DOUBLE AS length, (SELECT count(*) FROM v) - (SELECT count(*) FROM u) + (SELECT count(*) FROM c) AS outer_less_holes",
    "polygon_nesting": f"""WITH {_RINGS}, l AS (SELECT p.id, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM s p JOIN s q ON q.id = p.id AND q.k = (p.k + 1) % p.n),
      w AS (SELECT p.id, p.k, l.id AS around, count(*) FILTER (WHERE (l.px <= p.x) <> (l.qx <= p.x) AND l.py + (p.x - l.px) * (l.qy - l.py) / (l.qx - l.px) > p.y) AS m FROM s p JOIN l ON l.id <> p.id GROUP BY ALL),
      h AS (SELECT id, around FROM w GROUP BY ALL HAVING bool_and(m % 2 = 1)), z AS (SELECT id, sum(px * qy - qx * py) / 2 AS area FROM l GROUP BY id)
      SELECT g.id, arg_min(around, z.area) AS parent, count(around) AS depth FROM g LEFT JOIN h USING (id) LEFT JOIN z ON z.id = around GROUP BY g.id""",
    "ring_areas": f"WITH {_RINGS} SELECT p.id, round(sum(p.x * q.y - q.x * p.y) / 2, 6) + 0.0 AS area, any_value(p.n)::INTEGER AS n FROM s p JOIN s q ON q.id = p.id AND q.k = (p.k + 1) % p.n GROUP BY p.id",
}
