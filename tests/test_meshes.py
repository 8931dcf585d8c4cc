"""Golden values of generated meshes, round trips of files, kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.functions import kernels as K
from meshloom.operators import boundary as B
from meshloom.operators import cases as C
from meshloom.operators import generate as G
from meshloom.operators import spatial as P
from meshloom.operators import surface as S
from meshloom.operators import topology as T
from meshloom.plans import mesh as M
from meshloom.plans.surfaces import CUBE, CUBE_FACES, box_surface
from meshloom.sources import config, meshes, text, writers


def test_resolutions():
    assert G.box_resolution((51.3, 40.0, 218.0), grid=10.0) == (6, 4, 22)
    assert G.cylinder_resolution(620.0, 1924.0, 4, grid=40.0, factors=(1.25, 0.8, 1.25)) == (5, 5, 39)
    assert G.annulus_resolution(10.0, 8.0, 1.0, grid=100.0) == (3, 1, 1)
    assert G.box_resolution((1, 1, 1), (2, None, 4), grid=0.5) == (2, 2, 4)
    with pytest.raises(ValueError):
        G.box_resolution((1, 1, 1))


def test_hybrid_golden(spark, monkeypatch):
    monkeypatch.setattr(M, "layers", lambda *_: 39)
    by = {r["level"]: r for r in M.hybrid_nodes(spark, "").collect()}
    assert sum(r["n"] for r in by.values()) == 11787
    assert [by[k]["first_vid"] for k in (0, 10, 11, 24, 39)] == [1, 3211, 3211 + 321, 6652, 11467]
    assert by[0]["n"] == 321 and by[11]["n"] == 240


def test_box_invariants(spark):
    n = (4, 3, 2)
    nodes, cells = G.box_nodes(spark, (0, 0, 0), (4.0, 3.0, 2.0), n), G.box_cells(spark, n)
    assert T.boundary_faces(cells).count() == 2 * (4 * 3 + 3 * 2 + 4 * 2)
    assert T.owners(cells).where("n = 2").count() == 3 * 24 - (12 + 6 + 8)
    assert T.conflicts(cells).isEmpty()
    assert T.component_sizes(cells).collect()[0]["n"] == 24
    assert nodes.agg(F.sum("knpr")).first()[0] == 60 - 3 * 2 * 1


def test_box_inflow_keeps_faces_out_of_the_wall(spark):
    n = (4, 4, 1)
    nodes, cells = G.box_nodes(spark, (0, 0, 0), (4.0, 4.0, 1.0), n), G.box_cells(spark, n)
    disc = B.Inflow(4, (0, 0, 1), (2.0, 2.0, 0.0), outer_radius=0.2)
    tagged = B.classify_box(nodes, cells, (0, 0, 0), (4, 4, 1), [disc])
    by = {r["bucket"]: r["n"] for r in B.buckets(tagged).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by["inflow1"] == 4 and by["zmin"] == 12 and "wall" not in by
    stamp = B.inflow_stamp(B.buckets(tagged)).collect()
    assert {r["inflow_id"] for r in stamp} == {1, -1}


def test_cylinder_inflow_falls_into_the_wall(spark):
    n = (12, 2, 2)
    nodes, cells = G.annulus_nodes(spark, 20.0, 10.0, 40.0, 0.0, n), G.annulus_cells(spark, n)
    ring = B.Inflow(2, (0, 0, 1), (0, 0, 0), outer_radius=10.1, inner_radius=4.9)
    tagged = B.classify_cylinder(nodes, cells, 20.0, 10.0, 0.0, 40.0, [ring])
    by = {r["bucket"]: r["n"] for r in B.buckets(tagged).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by["inflow1"] == by["wall"] == 24 and "zmin" not in by
    assert by["outer"] == by["inner"] == 24 and by["zmax"] == 24
    assert B.unclassified(tagged, T.boundary_faces(cells)).first() == (0, 0)


def test_cylinder_constraints_and_targets(spark):
    n = (8, 2, 2)
    nodes, cells = G.annulus_nodes(spark, 4.0, 2.0, 2.0, 0.0, n), G.annulus_cells(spark, n)
    masks = B.cylinder_constraints(nodes, cells, 4.0, 2.0, 0.0, 2.0)
    moved = masks.withColumns({"tx": F.col("x") * 1.1, "ty": F.col("y") * 1.1, "tz": F.col("z") + 0.1})
    held = B.enforce_cylinder(moved, 4.0, 2.0, 0.0, 2.0)
    far = held.where(F.col("mask").bitwiseAND(B.BITS["outer"]) != 0).select(F.max(F.abs(F.hypot("x", "y") - 2.0))).first()[0]
    assert far < 1e-12
    assert {r["name"]: r["n"] for r in B.constraint_counts(masks).collect()}["outer"] == 24


def test_files_round_trip(spark, tmp_path):
    n = (2, 2, 2)
    nodes, cells = G.box_nodes(spark, (0, 0, 0), (1, 1, 1), n), G.box_cells(spark, n).withColumn("monitor", F.lit(2))
    writers.write_tri(f"{tmp_path}/a.tri", nodes, cells)
    head, back, kvert = meshes.read_tri(spark, f"{tmp_path}/a.tri")
    assert (head["nel"], head["nvt"]) == (8, 27)
    assert sorted(back.collect()) == sorted(nodes.collect())
    assert sorted(map(str, kvert.collect())) == sorted(map(str, cells.select("cid", "kvert").collect()))
    writers.write_vtu_volume(f"{tmp_path}/a.vtu", nodes, cells, {"knpr": "Int32"}, {"monitor": "Int32"})
    volume, hexes = meshes.read_vtu_volume(spark, f"{tmp_path}/a.vtu")
    assert volume.count() == 27 and {r["monitor"] for r in hexes.collect()} == {2}
    sv, sf = box_surface(spark)
    writers.write_vtu_surface(f"{tmp_path}/s.vtu", sv, sf.withColumn("data", F.col("fid").cast("int")), {"data": "UInt32"})
    _, again = meshes.read_surface(spark, f"{tmp_path}/s.vtu")
    assert all(r["data"] == r["fid"] and list(r["v"]) == list(CUBE_FACES[r["fid"]]) for r in again.collect())
    writers.write_area(f"{tmp_path}/area.txt", spark.range(1, 6).select(F.col("id").alias("cid"), (F.col("id") / 2).alias("value")))
    assert [r["value"] for r in meshes.read_area(spark, f"{tmp_path}/area.txt", cells).orderBy("cid").collect()] == [0.5, 1.0, 1.5, 2.0, 2.5, 0.0, 0.0, 0.0]
    assert writers.write_par(f"{tmp_path}/wall.par", nodes, "Wall") == 27


def test_off_reader(spark, tmp_path):
    body = "OFF\n# a cube\n8 6 0\n\n" + "".join(f"{x} {y} {z}\n" for x, y, z in CUBE) + "4 0 2 3 1\n4 4 5 7 6\n4 0 1 5 4\n4 2 6 7 3\n4 0 4 6 2\n4 1 3 7 5\n"
    (tmp_path / "c.off").write_text(body)
    sv, sf = meshes.read_surface(spark, f"{tmp_path}/c.off")
    assert tuple(T.surface_summary(sf).first()) == (8, 18, 12, True, True)
    assert abs(S.orientation(S.corners(sv, sf)).first()["volume"] - 1) < 1e-12
    with pytest.raises(ValueError):
        meshes.read_surface(spark, f"{tmp_path}/c.stl")


def test_settings(spark, tmp_path):
    (tmp_path / "setup.e3d").write_text(
        "[E3DGeometryData/Preprocessing]\ngeometryStart = -31.3,-20,0\ngeometryLength = 51.3,40,218\nHexMesher=Box\n"
        "[E3DProcessParameters/Inflow_1]\ntype = CURVEDFLAT\nInnerRadius = 16\nOuterRadius = 20\ncenter = 7,0,0\nnormal = 0,0,1\n"
    )
    s = text.settings(text.lines(spark, f"{tmp_path}/setup.e3d"))
    assert config.mesh_config(s).geometry_length == (51.3, 40.0, 218.0)
    (flow,) = config.inflows(s)
    assert (flow.type_id, flow.outer_radius, flow.normal) == (4, 20.0, (0.0, 0.0, 1.0))
    (tmp_path / "p.cfg").write_text("[A]\ncoarse_mesh_scaling = 2.5  # note\nmax_histogram_span_bins = x\n")
    c = config.engine_config(f"{tmp_path}/p.cfg")
    assert (c.coarse_mesh_scaling, c.max_histogram_span_bins) == (2.5, 3)


def test_dense_ids_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k"))
    got = [(r["k"], r["i"]) for r in T.dense_ids(rows, ["k"], "i").collect()]
    assert sorted(got) == [(k, i + 1) for i, k in enumerate(sorted(x * 37 % 1009 for x in range(1000)))]


def test_components_of_a_chain(spark):
    ids = spark.range(300)
    links = spark.range(299).where("id % 100 != 99").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in T.components(ids, links).collect()} == {0, 100, 200}


def test_kernels():
    cube = np.array([[CUBE[i] for i in f] for f in CUBE_FACES], float)
    gap, _ = K.closest_on_triangles(np.array([[2.0, 0, 0], [0, 0, 0.2]]), cube)
    assert np.allclose(np.sqrt(gap.min(1)), [1.5, 0.3])
    assert np.allclose(K.winding_number(np.array([[0, 0, 0.0], [2, 0, 0]]), cube), [1, 0], atol=1e-9)
    assert len(K.hex_tetrahedra()) == 40
    corners = np.array([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)], float)
    points = K.hex_points(corners)
    tets = points[K.hex_tetrahedra()]
    volume = np.abs(np.einsum("ij,ij->i", tets[:, 1] - tets[:, 0], np.cross(tets[:, 2] - tets[:, 0], tets[:, 3] - tets[:, 0]))).sum() / 6
    assert math.isclose(volume, 1.0, rel_tol=1e-12)
    center, r = K.minimal_sphere(corners)
    assert np.allclose(center, 0.5) and math.isclose(r, math.sqrt(3) / 2)
    kind, shared = K.clip_triangle(np.array([[0.1, 0.1, 0.1], [5, 0.1, 0.1], [0.1, 5, 0.1]]), np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]]))
    assert kind == 3 and math.isclose(K.area_of(shared), 0.7**2 / 2, rel_tol=1e-9)


def test_slab_gap(spark):
    from meshloom.plans.texts import slab

    # twelve triangles: the spheres of the wide sides span the slab
    rows = {r.fid: r.diameter for r in P.inscribed(S.corners(*box_surface(spark, (10.0, 200.0, 200.0)))).collect()}
    assert all(abs(rows[k] - 10) < 0.1 for k in (8, 9, 10, 11)) and all(6.6 < rows[k] < 6.7 for k in range(8))
    # squares far from the rim have no way round to the other side, so they are the gap
    sv, sf = slab(spark, 10)
    assert S.orientation(S.corners(sv, sf)).first()["volume"] > 0
    found, _ = C.find_min_gap(sv, sf)
    assert abs(found.raw - 10) < 0.1 and abs(found.coarse - found.adjusted * 1.5 * 3.0**found.span) < 1e-6
    assert C.corrected(9.0, 3, 0.5) == (3.0, 2) and C.corrected(9.0, 3, 5.0) is None
    assert C.valid_for_queries(*box_surface(spark)) is None


def test_crossing_triangles(spark):
    sv = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0), (3, 0.5, 0.5, -1.0), (4, 0.5, 0.5, 1.0), (5, 0.6, 3.0, 0.0)], "vid long, x double, y double, z double")
    sf = spark.createDataFrame([(0, [0, 1, 2]), (1, [3, 4, 5])], "fid long, v array<long>")
    assert [tuple(r) for r in P.crossings(S.corners(sv, sf)).collect()] == [(0, 1, 0)]


def test_stage_stream(spark, tmp_path):
    from meshloom.streaming import cases as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("[clean] start c1\nnoise\n[clean] done c1\n[refine] start c1\n")
    counts = stream.stage_counts(stream.stage_events(spark, f"{tmp_path}/in"))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("stages").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("stages").collect()) == [("clean", "done", 1), ("clean", "start", 1), ("refine", "start", 1)]


def test_refinement_by_templates(spark, tmp_path):
    from meshloom.operators import refine as R

    n = (3, 2, 2)
    nodes, cells = G.box_nodes(spark, (0, 0, 0), (3, 2, 2), n), G.box_cells(spark, n)
    full = R.thirds()
    new_nodes, new_cells, unknown = R.refine_by_templates(nodes, cells, nodes.select("vid"), [full])
    assert new_cells.count() == 12 * 27 and new_nodes.count() == 10 * 7 * 7 and unknown.isEmpty()
    assert T.owners(new_cells).agg(F.max("n")).first()[0] == 2
    from meshloom.operators.monitor import cell_volumes

    volume = cell_volumes(new_nodes, new_cells).agg(F.sum("volume"), F.min("volume"), F.max("volume")).first()
    assert math.isclose(volume[0], 12.0, rel_tol=1e-9) and math.isclose(volume[1], volume[2], rel_tol=1e-9)
    one = nodes.where("vid = 1").select("vid")
    same_nodes, same_cells, unknown = R.refine_by_templates(nodes, cells, one, [full])
    assert same_cells.count() == 12 and same_nodes.count() == 36 and [tuple(r) for r in unknown.collect()] == [("10000000", 1)]
    # a template that cuts a cell in two across the edges of its marked face, whichever face that is
    half = R.Template("11110000", (*R.whole().points[:4], (-1, -1, 0), (1, -1, 0), (1, 1, 0), (-1, 1, 0), *R.whole().points[4:]), ((0, 1, 2, 3, 4, 5, 6, 7), (4, 5, 6, 7, 8, 9, 10, 11)))
    end = nodes.where("x = 3").select("vid")
    cut_nodes, cut_cells, unknown = R.refine_by_templates(nodes, cells, end, [half])
    assert cut_cells.count() == 16 and cut_nodes.count() == 36 + 9 and unknown.isEmpty()
    assert T.owners(cut_cells).agg(F.max("n")).first()[0] == 2
    assert math.isclose(cell_volumes(cut_nodes, cut_cells).agg(F.sum("volume")).first()[0], 12.0, rel_tol=1e-9)


def test_settings_are_rewritten():
    from meshloom.operators.round import rewrite_settings

    lines = ["[A]", "x = 1", "", "[B]", "y = 2"]
    assert rewrite_settings(lines, "a", {"X": "5", "z": "6"}) == ["[A]", "X = 5", "z = 6", "", "[B]", "y = 2"]
    assert rewrite_settings(lines, "C", {"q": "1"})[-2:] == ["[C]", "q = 1"]


def test_grid_searches_agree_with_brute_force(spark):
    """A closed surface with triangles of very different sizes: a large cube whose top is an uneven field of small ones."""
    rng, m = np.random.default_rng(5), 12
    top = {(i, j): (i / m * 4, j / m * 4, 4 + (rng.uniform(-0.4, 0.4) if 0 < i < m and 0 < j < m else 0)) for i in range(m + 1) for j in range(m + 1)}
    tri = [[top[p] for p in q] for i in range(m) for j in range(m) for q in (((i, j), (i + 1, j), (i + 1, j + 1)), ((i, j), (i + 1, j + 1), (i, j + 1)))]
    tri += [[(0, 0, 0), (4, 4, 0), (4, 0, 0)], [(0, 0, 0), (0, 4, 0), (4, 4, 0)]]
    rim = [[(k, 0) for k in range(m + 1)], [(m, k) for k in range(m + 1)], [(m - k, m) for k in range(m + 1)], [(0, m - k) for k in range(m + 1)]]
    for side in rim:
        a, b = ((*top[side[k]][:2], 0.0) for k in (0, -1))
        tri += [[a, top[side[k + 1]], top[side[k]]] for k in range(m)] + [[a, b, top[side[-1]]]]
    tri = np.array(tri, float)
    names = [f"{p}_{c}" for p in "abc" for c in "xyz"]
    faces = spark.createDataFrame([(i, *map(float, t.ravel())) for i, t in enumerate(tri)], "fid long, " + ", ".join(f"{c} double" for c in names))
    p = np.vstack([rng.uniform(-1, 5.5, (150, 3)), rng.uniform(-300, 300, (10, 3))])
    d = rng.normal(size=p.shape)
    d[:20, 0] = 0
    d[10:20, 1] = 0
    rows = [(i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(p, d, strict=True))]
    points = spark.createDataFrame([*rows, (len(rows), None, 0.0, 0.0, 1.0, 0.0, 0.0)], "id long, x double, y double, z double, dx double, dy double, dz double")
    gap = np.sqrt(K.closest_on_triangles(p, tri)[0]).min(1)
    found = {r["id"]: r["distance"] for r in P.nearest(points, faces).collect()}
    assert sorted(found) == list(range(len(p))) and np.allclose([found[i] for i in range(len(p))], gap, atol=1e-9)
    wound = np.abs(K.winding_number(p, tri)) > 0.5
    assert 0 < wound.sum() < len(p)
    assert {r["id"]: r["inside"] for r in P.inside(points, faces).collect()} == {**dict(enumerate(wound.tolist())), len(p): False}
    first = K.ray_hits(p, d, tri).min(1)
    hits = {r["id"]: r["distance"] for r in P.first_hits(points, faces).collect()}
    assert len(hits) == len(p) + 1 and all(hits[i] is None if np.isinf(t) else abs(hits[i] - t) < 1e-9 for i, t in enumerate(first))
    ends = points.selectExpr("id", "x", "y", "z", "x + dx AS ex", "y + dy AS ey", "z + dz AS ez")
    assert {r["id"]: r["hit"] for r in P.segments_hit(ends, faces).collect()} == {**{i: bool(t <= 1) for i, t in enumerate(first)}, len(p): False}
    none = faces.limit(0)
    assert P.nearest(points, none).count() == 0 and P.first_hits(points, none).where("distance IS NOT NULL").count() == 0
    assert not P.inside(points, none).where("inside").count() and not P.segments_hit(ends, none).where("hit").count()


def test_files_are_written_by_many_tasks_in_order(spark, tmp_path):
    from meshloom.sources import ordered, writers

    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else few lines are one partition
    try:
        rows = spark.range(0, 5000, 1, 8).select((4999 - F.col("id")).alias("cid"), F.col("id").alias("value"))
        writers.write_area(f"{tmp_path}/a.txt", rows)
        points = spark.range(60).select((F.col("id") % 3).alias("line"), (-F.col("id")).alias("pos"), *[F.col("id").cast("double").alias(c) for c in "xyz"])
        writers.write_vtp(f"{tmp_path}/a.vtp", points)
        ordered.write_sections(spark, f"{tmp_path}/b.txt", ["one\ntwo\n", (spark.range(0).select("id"), ["id"], lambda r: "none"), "three"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert [int(x) for x in (tmp_path / "a.txt").read_text().split()] == list(range(4999, -1, -1))
    text = (tmp_path / "a.vtp").read_text().split("\n")
    first = next(i for i, x in enumerate(text) if 'Name="Points"' in x) + 1
    assert [x.split()[0] for x in text[first : first + 20]] == [str(i) for i in range(57, -1, -3)]
    ends = next(i for i, x in enumerate(text) if 'Name="offsets"' in x) + 1
    assert text[ends : ends + 3] == ["20", "40", "60"]
    assert (tmp_path / "b.txt").read_text() == "one\ntwo\nthree\n" and len(list(tmp_path.iterdir())) == 3  # no parts are left


def test_points_within_a_tolerance_are_merged(spark):
    """Two boxes that were cut from one by a hair, and a chain of near points."""
    n, cells = (2, 2, 2), G.box_cells(spark, (2, 2, 2))
    left = G.box_nodes(spark, (0, 0, 0), (2, 2, 2), n)
    right = G.box_nodes(spark, (2 + 1e-9, 0, 0), (2, 2, 2), n).withColumn("vid", F.col("vid") + 100)
    both = left.unionByName(right).select("vid", "x", "y", "z")
    every = cells.unionByName(cells.select((F.col("cid") + 100).alias("cid"), F.transform("kvert", lambda v: v + 100).alias("kvert")))
    nodes, merged = T.merge_mesh(both, every, 1e-6)
    assert nodes.count() == 5 * 3 * 3 and T.component_sizes(merged).collect() == [(1, 16)]
    chain = spark.createDataFrame([(i, 0.9 * i, 0.0, -0.0) for i in range(9)] + [(20, 50.0, 0.0, 0.0), (21, 50.0, 0.0, 0.0), (22, None, 0.0, 0.0), (23, math.nan, 0.0, 0.0)], "vid long, x double, y double, z double")
    found = {r.vid: r.into for r in T.merge_points(chain, 1.0).collect()}
    assert found == {**dict.fromkeys(range(9), 0), 20: 20, 21: 20, 22: 22, 23: 23}
