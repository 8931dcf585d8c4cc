"""Queries that search a surface: the height field over the embeddings, and one like it on whole numbers that folds and crosses itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators import cases as C
from meshloom.operators import spatial as P
from meshloom.operators import surface as S
from meshloom.plans.mesh import rounded, table
from meshloom.plans.surfaces import _FACES, SCALE, box_surface, component
from meshloom.plans.terrain import _A, _B, _C, _GROUND, _NORMAL, WIDTH, Sql, _cross, _distance, _dot, _minus, _v, ground, terrain

#: Steps of the folded field's grid, and how far its corners lie off it.
STEP, OFF, HEIGHT = 3, 16, 8
#: Height from which rays are sent down, and how long search paths may be.
ABOVE, LEAST_WIDTH, WIDTHS = 5.0, 0.2, 12.0


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z) near the height field, (dx, dy, dz) from ABOVE it downwards."""
    vid = F.col("vec_id")
    x, y = F.pmod(vid, F.lit(WIDTH)) + component(3) * SCALE, F.floor(vid / WIDTH) + component(4) * SCALE
    return table(spark, sf_dir, "embeddings").select(vid.alias("id"), x.alias("x"), y.alias("y"), (component(5) * SCALE).alias("z"), (component(6) * SCALE).alias("dx"), (component(7) * SCALE).alias("dy"), F.lit(-1.0).alias("dz"))


def folded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A field like the height field, its corners moved by several whole steps, so that it folds over and through itself."""
    vid = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings")
    x, y = STEP * F.pmod(vid, F.lit(WIDTH)) + F.floor(component(0) * OFF), STEP * F.floor(vid / WIDTH) + F.floor(component(1) * OFF)
    sv = rows.select(vid.alias("vid"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.floor(component(2) * HEIGHT).cast("double").alias("z"))
    return sv, terrain(spark, sf_dir)[1]


def self_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.crossings(S.corners(*folded(spark, sf_dir)))


def slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spheres of a slab whose thickness and width follow the numbers of regions and of suppliers."""
    thick, wide = (float(k * table(spark, sf_dir, t).count()) for k, t in ((2, "region"), (8, "supplier")))
    return rounded(P.inscribed(S.corners(*box_surface(spark, (thick, wide, wide)))).select("fid", "diameter"), "diameter")


def edge_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fid, topo): paths between triangles of the height field, to one some triangles on, within a width of the embedding's."""
    faces = ground(spark, sf_dir)
    n = table(spark, sf_dir, "embeddings").count()
    width = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), (LEAST_WIDTH + WIDTHS * F.abs(component(9))).alias("diameter"))
    records = faces.select("fid", F.floor(F.col("fid") / 2).alias("vec_id"), F.pmod(F.col("fid") * 3 + 5, F.lit(2 * n)).alias("opposite")).join(width, "vec_id")
    records = records.join(faces.select(F.col("fid").alias("opposite"), F.lit(True).alias("there")), "opposite", "left")
    records = records.select("fid", F.when(F.col("there"), F.col("opposite")).alias("opposite"), "diameter")
    return rounded(C.topological_distances(faces, records, 1.0), "topo")


QUERIES = {
    "terrain_nearest": lambda s, d: rounded(P.nearest(probes(s, d).select("id", "x", "y", "z"), ground(s, d)).select("id", "distance"), "distance"),
    "terrain_first_hit": lambda s, d: rounded(P.first_hits(probes(s, d).withColumn("z", F.lit(ABOVE)), ground(s, d)).select("id", "distance"), "distance"),
    "terrain_spheres": lambda s, d: rounded(P.inscribed(ground(s, d)).select("fid", "diameter"), "diameter"),
    "mis_slab": slab,
    "terrain_edge_paths": edge_paths,
    "self_crossings": self_crossings,
}

_PROBES = f"""pr AS (SELECT vec_id AS id, (vec_id % {WIDTH})::DOUBLE + embedding[4]::DOUBLE * {SCALE} AS o_x, (vec_id // {WIDTH})::DOUBLE + embedding[5]::DOUBLE * {SCALE} AS o_y, embedding[6]::DOUBLE * {SCALE} AS o_z,
  embedding[7]::DOUBLE * {SCALE} AS d_x, embedding[8]::DOUBLE * {SCALE} AS d_y, -1.0::DOUBLE AS d_z FROM embeddings)"""


def _plus(u: Sql, v: Sql) -> Sql:
    return tuple(f"({a} + {b})" for a, b in zip(u, v, strict=True))


def _times(u: Sql, s: str) -> Sql:
    return tuple(f"({a} * {s})" for a in u)


def _hit(origin: Sql, direction: Sql) -> str:
    """The place on a line where it meets the triangle a, b, c; null where it doesn't."""
    u, v, s = _minus(_B, _A), _minus(_C, _A), _minus(origin, _A)
    h, q = _cross(direction, v), _cross(s, u)
    det = _dot(u, h)
    p, r, t = (f"{_dot(*x)} / {det}" for x in ((s, h), (direction, q), (v, q)))
    return f"CASE WHEN abs({det}) > 1e-12 AND {p} >= 0 AND {r} >= 0 AND {p} + {r} <= 1 AND {t} > 1e-12 THEN {t} END"


def _closest(p: Sql, a: Sql, b: Sql, c: Sql) -> Sql:
    """The point of a triangle nearest to p: its foot in the plane if inside, else the nearest of those of the three sides."""
    u, v, w = _minus(b, a), _minus(c, a), _minus(p, a)
    n = _cross(u, v)
    nn = _dot(n, n)
    beta, gamma = f"({_dot(_cross(w, v), n)} / {nn})", f"({_dot(_cross(u, w), n)} / {nn})"
    feet = []
    for q, r in ((a, b), (b, c), (c, a)):
        d = _minus(r, q)
        t = f"greatest(0, least(1, {_dot(d, _minus(p, q))} / {_dot(d, d)}))"
        feet.append(_plus(q, _times(d, t)))
    gaps = [_dot(_minus(f, p), _minus(f, p)) for f in feet]
    inside = _plus(a, _plus(_times(u, beta), _times(v, gamma)))
    first, second = f"{gaps[0]} <= {gaps[1]} AND {gaps[0]} <= {gaps[2]}", f"{gaps[1]} <= {gaps[2]}"
    return tuple(f"CASE WHEN {beta} >= 0 AND {gamma} >= 0 AND {beta} + {gamma} <= 1 THEN {inside[i]} WHEN {first} THEN {feet[0][i]} WHEN {second} THEN {feet[1][i]} ELSE {feet[2][i]} END" for i in range(3))


def _at(name: str) -> Sql:
    return tuple(f"{name}[{i}]" for i in (1, 2, 3))


def _sign(u: Sql, v: Sql, w: Sql) -> str:
    return f"sign({_dot(_cross(u, v), w)})"


_S, _E, _T = _at("s"), _at("e"), [_at(f"t[{i}]") for i in (1, 2, 3)]
_N = _at("n")


def _side(p: Sql, q: Sql, r: Sql) -> str:
    """The side of p-q on which r lies, as seen against the normal n."""
    return _sign(_minus(q, p), _minus(r, p), _N)


def _between(p: Sql, a: Sql, b: Sql) -> str:
    return " AND ".join(f"{x} BETWEEN least({y}, {z}) AND greatest({y}, {z})" for x, y, z in zip(p, a, b, strict=True))


_SIDES = [(_T[i], _T[(i + 1) % 3]) for i in range(3)]
_FLAT = " OR ".join(
    [" AND ".join(f"s{i} >= 0" for i in range(3)), " AND ".join(f"e{i} >= 0" for i in range(3))]
    + [f"(x{i} * x{(i + 1) % 3} < 0 AND s{i} * e{i} < 0) OR (s{i} = 0 AND {_between(_S, a, b)}) OR (e{i} = 0 AND {_between(_E, a, b)}) OR (x{i} = 0 AND {_between(a, _S, _E)})" for i, (a, b) in enumerate(_SIDES)]
)
_FOLDED = f"""sv AS (SELECT vec_id AS vid, {STEP} * (vec_id % {WIDTH}) + floor(embedding[1]::DOUBLE * {OFF})::BIGINT AS x, {STEP} * (vec_id // {WIDTH}) + floor(embedding[2]::DOUBLE * {OFF})::BIGINT AS y, floor(embedding[3]::DOUBLE * {HEIGHT})::BIGINT AS z FROM embeddings),
sq AS (SELECT vec_id AS i FROM embeddings WHERE vec_id % {WIDTH} < {WIDTH - 1} AND vec_id + {WIDTH + 1} < (SELECT count(*) FROM embeddings)),
sf AS (SELECT 2 * i AS fid, [i, i + 1, i + {WIDTH + 1}] AS v FROM sq UNION ALL SELECT 2 * i + 1, [i, i + {WIDTH + 1}, i + {WIDTH}] FROM sq),
fc AS (SELECT fid, v, [[a.x, a.y, a.z], [b.x, b.y, b.z], [c.x, c.y, c.z]] AS t FROM sf JOIN sv a ON a.vid = v[1] JOIN sv b ON b.vid = v[2] JOIN sv c ON c.vid = v[3]),
nf AS (SELECT *, [{', '.join(_cross(_minus(_T[1], _T[0]), _minus(_T[2], _T[0])))}] AS n FROM fc),
ok AS (SELECT *, {', '.join(f'least({", ".join(f"t[{j}][{i}]" for j in (1, 2, 3))}) AS l{i}, greatest({", ".join(f"t[{j}][{i}]" for j in (1, 2, 3))}) AS h{i}' for i in (1, 2, 3))} FROM nf WHERE n <> [0, 0, 0]),
pr AS (SELECT f.fid AS a, g.fid AS b, f.v AS vp, g.v AS vq, f.t AS p, g.t AS q, f.n AS np, g.n AS nq, len(list_intersect(f.v, g.v))::INTEGER AS shared
  FROM ok f JOIN ok g ON f.fid < g.fid AND {' AND '.join(f'f.l{i} <= g.h{i} AND g.l{i} <= f.h{i}' for i in (1, 2, 3))}),
sg AS ({' UNION ALL '.join(f"SELECT a, b, shared, {x}[{i + 1}] AS s, {x}[{(i + 1) % 3 + 1}] AS e, {y} AS t, n{y} AS n FROM pr WHERE shared = 0 OR shared = 1 AND NOT list_contains(v{y}, v{x}[{i + 1}]) AND NOT list_contains(v{y}, v{x}[{(i + 1) % 3 + 1}])" for x, y in ("pq", "qp") for i in range(3))}),
k AS (SELECT *, sign({_dot(_N, _minus(_S, _T[0]))}) AS ds, sign({_dot(_N, _minus(_E, _T[0]))}) AS de,
  {', '.join(f'{_sign(_minus(_E, _S), _minus(a, _S), _minus(b, _S))} AS w{i}, {_side(a, b, _S)} AS s{i}, {_side(a, b, _E)} AS e{i}, {_side(_S, _E, a)} AS x{i}' for i, (a, b) in enumerate(_SIDES))} FROM sg),
hit AS (SELECT DISTINCT a, b, shared FROM k WHERE CASE WHEN ds * de > 0 THEN false WHEN ds = 0 AND de = 0 THEN {_FLAT} ELSE least(w0, w1, w2) >= 0 OR greatest(w0, w1, w2) <= 0 END),
side AS (SELECT *, CASE WHEN NOT list_contains(vq, vp[1]) THEN 1 WHEN NOT list_contains(vq, vp[2]) THEN 2 ELSE 3 END AS i, CASE WHEN NOT list_contains(vp, vq[1]) THEN 1 WHEN NOT list_contains(vp, vq[2]) THEN 2 ELSE 3 END AS j FROM pr WHERE shared = 2),
pair AS (SELECT a, b, shared, p[i % 3 + 1] AS s, p[(i + 1) % 3 + 1] AS e, p[i] AS own, q[j] AS other, np AS n FROM side),
flat AS (SELECT a, b, shared FROM pair WHERE {_dot(_N, _minus(_at('other'), _S))} = 0 AND {_side(_S, _E, _at('own'))} = {_side(_S, _E, _at('other'))})"""

_P, _D = _v("p"), _v("n")
_CENTER = _plus(_P, _times(_D, "r"))
_WAY = _minus(_v("q"), _P)
_OFF = _cross(_WAY, _D)
_SPHERES = f"""s0 AS (SELECT *, {', '.join(f'(({a} + {b}) + {c}) / 3 AS p_{k}' for a, b, c, k in zip(_A, _B, _C, 'xyz', strict=True))}, {', '.join(f'{e} AS g_{k}' for e, k in zip(_NORMAL, 'xyz', strict=True))},
  greatest({', '.join(f'sqrt({_dot(_minus(x, y), _minus(x, y))})' for x, y in ((_A, _B), (_B, _C), (_C, _A)))}) AS edge FROM fc),
o AS (SELECT CASE WHEN sum({_dot(_A, _cross(_B, _C))}) > 0 THEN -1.0 ELSE 1.0 END AS way, least({', '.join(f'max(greatest(a_{k}, b_{k}, c_{k})) - min(least(a_{k}, b_{k}, c_{k}))' for k in 'xyz')}) / 2 AS most FROM fc),
s1 AS (SELECT fid AS id, p_x, p_y, p_z, edge, most, {', '.join(f"g_{k} / sqrt({_dot(_v('g'), _v('g'))}) * way AS n_{k}" for k in 'xyz')} FROM s0, o),
ry AS (SELECT id, min({_hit(_P, _D)}) AS t FROM s1 JOIN fc ON fid <> id GROUP BY id),
it(id, k, r, live) AS (SELECT id, 0, least(most, coalesce(t / 2, most)), true FROM s1 JOIN ry USING (id)
  UNION ALL SELECT id, k + 1, CASE WHEN stays THEN r ELSE least(new, r) END, NOT stays AND r - new > 1e-6 FROM (
    SELECT *, fid = id OR along <= 0 OR gap >= r - 2 * CASE WHEN edge < 1.5 * r THEN r - sqrt(r * r - (edge / 2) * (edge / 2)) ELSE 0.02 * r END AS stays, CASE WHEN off = 0 THEN sqrt(size) ELSE size / (2 * along) END AS new FROM (
      SELECT *, {_dot(_WAY, _D)} AS along, {_dot(_WAY, _WAY)} AS size, {_dot(_OFF, _OFF)} AS off FROM (
        SELECT *, {', '.join(f'{e} AS q_{k}' for e, k in zip(_closest(_CENTER, _A, _B, _C), 'xyz', strict=True))} FROM (
          SELECT *, {_distance(_CENTER, (_A, _B, _C))} AS gap FROM it JOIN s1 USING (id) JOIN fc ON true WHERE live AND k < 200 QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap, fid) = 1)))))"""

_SLAB = f"""{_FACES}, d AS (SELECT 2.0::DOUBLE * (SELECT count(*) FROM region) AS sx, 8.0::DOUBLE * (SELECT count(*) FROM supplier) AS sy),
fc AS (SELECT fid::BIGINT AS fid, {', '.join(f'({p} % 2 - 0.5::DOUBLE) * sx AS {p}_x, ({p} // 2 % 2 - 0.5::DOUBLE) * sy AS {p}_y, ({p} // 4 - 0.5::DOUBLE) * sy AS {p}_z' for p in 'abc')} FROM f, d)"""

_PATHS = f"""e2 AS (SELECT s AS a, t AS b FROM ed UNION SELECT t, s FROM ed), el AS (SELECT a, b, sqrt({_dot(_minus(('p.x', 'p.y', 'p.z'), ('q.x', 'q.y', 'q.z')), _minus(('p.x', 'p.y', 'p.z'), ('q.x', 'q.y', 'q.z')))}) AS l FROM e2 JOIN sv p ON p.vid = a JOIN sv q ON q.vid = b),
rc AS (SELECT f.fid, g.fid AS opposite, [f.va, f.vb, f.vc] AS own, [g.va, g.vb, g.vc] AS goal, greatest(pi() * ({LEAST_WIDTH}::DOUBLE + {WIDTHS} * abs(embedding[10]::DOUBLE)), {S.SEARCH_RADIUS}) AS far
  FROM sf f JOIN embeddings ON vec_id = f.fid // 2 LEFT JOIN sf g ON g.fid = (f.fid * 3 + 5) % (2 * (SELECT count(*) FROM embeddings))),
wk(fid, k, vid, d) AS (SELECT fid, 0, unnest(own), 0.0::DOUBLE FROM rc WHERE opposite IS NOT NULL
  UNION ALL SELECT fid, k + 1, vid, d FROM (SELECT w.fid, w.k, b AS vid, min(d + l) AS d FROM wk w JOIN el ON a = w.vid JOIN rc ON rc.fid = w.fid WHERE d + l <= far GROUP BY w.fid, w.k, b))"""

SQL = {
    "terrain_nearest": f"WITH {_GROUND}, {_PROBES} SELECT id, round(min({_distance(_v('o'), (_A, _B, _C))}), 6) + 0.0 AS distance FROM pr JOIN fc ON true GROUP BY id",
    "terrain_first_hit": f"WITH {_GROUND}, {_PROBES}, hi AS (SELECT * REPLACE ({ABOVE}::DOUBLE AS o_z) FROM pr) SELECT id, round(min({_hit(_v('o'), _v('d'))}), 6) + 0.0 AS distance FROM hi JOIN fc ON true GROUP BY id",
    "terrain_spheres": f"WITH RECURSIVE {_GROUND}, {_SPHERES} SELECT id AS fid, round(2 * arg_max(r, k), 6) + 0.0 AS diameter FROM it GROUP BY id",
    "mis_slab": f"WITH RECURSIVE {_SLAB}, {_SPHERES} SELECT id AS fid, round(2 * arg_max(r, k), 6) + 0.0 AS diameter FROM it GROUP BY id",
    "terrain_edge_paths": f"WITH RECURSIVE {_GROUND}, {_PATHS}, b AS (SELECT w.fid, min(d) AS d FROM wk w JOIN rc ON rc.fid = w.fid AND list_contains(goal, w.vid) GROUP BY w.fid) SELECT rc.fid, round(coalesce(d, -1), 6) + 0.0 AS topo FROM rc LEFT JOIN b USING (fid)",
    "self_crossings": f"WITH {_FOLDED} SELECT * FROM hit UNION ALL SELECT * FROM flat",
}
