"""Box topology from row numbers against the operators for any mesh, and without shuffles of cells."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from meshloom.operators import boundary as B
from meshloom.operators import deform as D
from meshloom.operators import generate as G
from meshloom.operators import monitor as M
from meshloom.operators import refine as R
from meshloom.operators import structured as X
from meshloom.operators import topology as T
from meshloom.plans import catalog

DATA = "/root/testdata/sf0.001"
START, LENGTHS = (-1.0, 2.0, 0.5), (3.0, 1.5, 7.0)
SIZES = [(1, 1, 1), (2, 1, 3), (4, 3, 5)]


def rows(df):
    columns = sorted(df.columns)
    return sorted(repr([r[c] for c in columns]) for r in df.collect())


def keep(i, j, k):
    return ((i + j) % 3 != 1) & (k % 4 != 2) | (i == 0)


@pytest.mark.parametrize("n", SIZES)
def test_topology_is_that_of_the_cells(spark, n):
    nodes, cells = G.box_nodes(spark, START, LENGTHS, n), G.box_cells(spark, n)
    assert rows(X.boundary_faces(spark, n)) == rows(T.boundary_faces(cells))
    assert rows(X.adjacency(spark, n)) == rows(T.adjacency(cells))
    assert rows(X.span(cells.select("cid"), n)) == rows(T.span(cells))
    assert rows(X.edge_table(spark, n)) == rows(T.edge_table(cells))
    assert rows(X.is_boundary_cell(spark, n)) == rows(T.is_boundary_cell(cells))
    assert X.min_edge(spark, START, LENGTHS, n).first()[0] == T.min_edge(nodes, cells).first()[0]


@pytest.mark.parametrize("n", SIZES)
def test_sides_are_tagged_as_faces_of_any_mesh(spark, n):
    nodes, cells = G.box_nodes(spark, START, LENGTHS, n), G.box_cells(spark, n)
    inflow = B.Inflow(1, (0.0, 0.0, 1.0), (0.0, 2.5, 0.5), outer_radius=1.0)
    tol = B.tolerance_of(nodes, cells, B.BOX_FACTOR)
    found = B.tagged_box(B.measured(X.boundary_faces(spark, n, START, LENGTHS)), tol, START, LENGTHS, [inflow])
    tagged = B.buckets(found)
    wanted = B.buckets(B.classify_box(nodes, cells, START, LENGTHS, [inflow]))
    assert rows(tagged.select("cid", "lf", "bucket")) == rows(wanted.select("cid", "lf", "bucket"))
    whole = B.tagged_box(B.measured(X.boundary_faces(spark, n, START, LENGTHS)), tol, START, LENGTHS)
    owned = whole.select(F.explode("planes").alias("bucket"), "owned").groupBy("bucket").agg(F.sum("owned").cast("long").alias("n"))
    planes = B.bucket_nodes(B.buckets(B.classify_box(nodes, cells, START, LENGTHS))).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    assert rows(owned) == rows(planes)


@pytest.mark.parametrize("n", SIZES)
def test_values_of_some_cells_stand_for_all(spark, n):
    nodes, cells = G.box_nodes(spark, START, LENGTHS, n), G.box_cells(spark, n)
    some = cells.where("cid % 5 = 1").select("cid", F.col("cid").cast("double").alias("value"))
    every = cells.select("cid").join(some, "cid", "left").select("cid", F.coalesce("value", F.lit(0.0)).alias("value"))
    assert rows(X.vertex_means(spark, some, n)) == rows(M.vertex_means(cells, every, "value"))
    marks = some.select("cid", F.when(F.col("cid") % 2 == 0, 3).otherwise(2).alias("level"))
    wanted = R.smooth_levels(cells, cells.select("cid").join(marks, "cid", "left").select("cid", F.coalesce("level", F.lit(0)).alias("level")), 3)
    found = X.smooth_levels(marks, n, 3).withColumnRenamed("cid", "id")
    assert rows(X.filled(spark, math.prod(n), found, F.col("level"), F.lit(0), "level").withColumnRenamed("id", "cid")) == rows(wanted)
    weights = nodes.select("vid", (1.0 + F.pmod("vid", F.lit(7)) / 7.0).alias("w"))
    assert rows(X.umbrella_step(spark, START, LENGTHS, n, lambda vid: 1.0 + F.pmod(vid, F.lit(7)) / 7.0)) == rows(D.umbrella_step(nodes, cells, weights))


@pytest.mark.parametrize("n", [*SIZES, (5, 4, 9)])
def test_kept_cells_are_numbered_and_labelled_in_slabs(spark, n):
    nodes, cells = G.box_nodes(spark, START, LENGTHS, n), G.box_cells(spark, n)
    kept = cells.where(keep(*X.place("cid", n)))
    new_nodes, new_cells = T.reduce_mesh(nodes, cells, kept)
    at = [F.col("kvert")[i].alias(f"v{i + 1}") for i in range(8)]
    assert rows(X.kept_cells(spark, n, keep)) == rows(new_cells.select("cid", *at))
    assert sorted(r[0] for r in X.kept_nodes(spark, n, keep).collect()) == sorted(r[0] for r in new_nodes.select("vid").collect())
    wanted = rows(T.component_sizes(kept))
    for slab in (1, 3 * n[0] * n[1], X.SLAB):
        assert rows(X.component_sizes(spark, n, keep, slab)) == wanted


#: Queries of box meshes whose cells, faces and nodes are made where they are read.
WITHOUT_SHUFFLE = "box_inflow_tags box_adjacency vertex_span shared_edges box_boundary_cells box_boundary_faces box_knpr umbrella_step constraint_masks constraint_project".split()


@pytest.mark.parametrize("name", WITHOUT_SHUFFLE)
def test_no_cells_are_shuffled(spark, name):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("name", ["box_plane_tags", "box_unclassified", "box_volume", "box_inflow_nodes", "component_sizes", "level_smoothing", "inflow_boost", "refinement_distribution", "refinement_nodes", "dense_renumber"])
def test_the_general_operators_are_not_asked(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("cells went through a join of all their faces, corners or edges")

    for operator in ("faces", "span", "corners_of", "cell_edges", "dense_ids"):
        monkeypatch.setattr(T, operator, refuse)
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_tasks_of_axis_mesh_edges_have_bounded_rows(spark):
    n = (3000, 5, 3000)
    rows = 2 * 3000 * 6 * 3001 + 3001 * 5 * 3001
    assert G.axis_mesh(spark, n, "edge").rdd.getNumPartitions() * G.TASK_ROWS >= rows


def test_tasks_of_axis_mesh_faces_have_bounded_rows(spark):
    n = (3000, 5, 3000)
    rows = 2 * 3000 * 5 * 3001 + 3000 * 6 * 3000
    assert G.axis_mesh(spark, n, "face").rdd.getNumPartitions() * G.TASK_ROWS >= rows


def test_tasks_over_cells_have_bounded_rows(spark):
    n = (3000, 5, 3000)
    for cells in (G.box_cells(spark, n), X.span(G.box_cells(spark, n).select("cid"), n), X.adjacency(spark, n), X.edge_table(spark, n)):
        assert cells.rdd.getNumPartitions() * G.TASK_ROWS >= math.prod(n)


def test_tasks_of_box_nodes_have_bounded_rows(spark):
    n = (3000, 5, 3000)
    assert G.box_nodes(spark, START, LENGTHS, n).rdd.getNumPartitions() * G.TASK_ROWS >= 3001 * 6 * 3001


def tensor_grid(n, kind):
    """(id, axis, nodes) of edges or faces of a tensor grid, one by one."""
    steps = [1, n[0] + 1, (n[0] + 1) * (n[1] + 1)]
    out = []
    for axis, along in enumerate([(0,), (1,), (2,)] if kind == "edge" else [(0, 1), (0, 2), (1, 2)]):
        size = [n[d] + (d not in along) for d in range(3)]
        for k, j, i in itertools.product(*map(range, reversed(size))):
            corners = [i * steps[0] + j * steps[1] + k * steps[2]]
            for d in along:
                corners += [c + steps[d] for c in corners]
            out.append((len(out), axis, *corners))
    return out


@pytest.mark.parametrize("n", [*SIZES, (31, 2, 1), (32, 1, 2), (70, 3, 2), (3, 0, 2), (0, 0, 0)])
@pytest.mark.parametrize("kind", ["edge", "face"])
def test_axis_mesh_has_every_edge_and_face_once(spark, n, kind):
    found = G.axis_mesh(spark, n, kind)
    assert sorted(tuple(r) for r in found.collect()) == tensor_grid(n, kind)
    assert [t for _, t in found.dtypes] == ["bigint", "int", *["bigint"] * (len(found.columns) - 2)]


@pytest.mark.parametrize(("kind", "most"), [("face", 14), ("edge", 10)])
def test_rows_of_axis_mesh_take_little_space_when_written(spark, tmp_path, kind, most):
    out = str(tmp_path / kind)
    G.axis_mesh(spark, (500, 5, 500), kind).coalesce(1).write.parquet(out)
    written = sum(f.stat().st_size for f in (tmp_path / kind).glob("*.parquet"))
    assert written <= most * spark.read.parquet(out).count()


def bytes_a_row(df, out):
    df.coalesce(1).write.parquet(str(out))
    return sum(f.stat().st_size for f in out.glob("*.parquet")) / df.count()


WIDE = [(1, 2, 2), (31, 2, 1), (33, 3, 2), (65, 1, 3)]


@pytest.mark.parametrize("n", WIDE)
def test_adjacency_by_blocks_is_that_of_the_cells(spark, n):
    assert rows(X.adjacency(spark, n)) == rows(T.adjacency(G.box_cells(spark, n)))


def test_rows_of_adjacency_take_little_space_when_written(spark, tmp_path):
    assert bytes_a_row(X.adjacency(spark, (250, 5, 250)), tmp_path / "out") < 3


@pytest.mark.parametrize("n", [*SIZES, *WIDE])
def test_span_by_blocks_is_that_of_the_cells(spark, n):
    assert rows(X.spans(spark, n)) == rows(T.span(G.box_cells(spark, n)))


def test_rows_of_vertex_span_take_little_space_when_written(spark, tmp_path):
    assert bytes_a_row(X.spans(spark, (250, 5, 250)), tmp_path / "out") < 2
    n = (3000, 5, 3000)
    assert X.spans(spark, n).rdd.getNumPartitions() * G.TASK_ROWS >= math.prod(n) * 20


def longest_method(df):
    """Bytes of the longest generated method; above 8000 the JVM interprets it and never compiles it."""
    plans = getattr(getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    found = plans.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size()))


@pytest.mark.parametrize("n", [*SIZES, *WIDE])
def test_edges_of_cells_by_blocks_are_those_of_the_cells(spark, n):
    assert rows(X.cell_edges(spark, n)) == rows(T.cell_edges(G.box_cells(spark, n)))


def test_edges_of_cells_are_made_by_compiled_code(spark):
    assert longest_method(catalog.queries()["box_cell_edges"](spark, DATA)) < 8000


@pytest.mark.parametrize("n", WIDE)
def test_edges_by_blocks_are_those_of_the_cells(spark, n):
    assert rows(X.edge_table(spark, n)) == rows(T.edge_table(G.box_cells(spark, n)))


def test_edges_are_made_by_compiled_code(spark):
    assert longest_method(catalog.queries()["shared_edges"](spark, DATA)) < 8000


def test_slabs_of_components_meet_where_few_cells_do(spark, monkeypatch):
    """Of components that one slab holds, no link is joined."""
    from meshloom.plans.mesh import marked

    n, seen, joined = (12, 5, 31), [], T.components
    monkeypatch.setattr(T, "components", lambda ids, links: seen.append(links.count()) or joined(ids, links))
    kept = G.box_cells(spark, n).where(marked(*X.place("cid", n)))
    assert rows(X.component_sizes(spark, n, marked, 4 * n[0] * n[1])) == rows(T.component_sizes(kept))
    assert seen[0] <= 2 * 8  # one component goes through all slabs


@pytest.mark.parametrize("slabs", [1, 2, 4, 7])
def test_slabs_of_any_depth_have_the_same_components(spark, slabs):
    n = (5, 4, 13)
    wanted = rows(T.component_sizes(G.box_cells(spark, n).where(keep(*X.place("cid", n)))))
    assert rows(X.component_sizes(spark, n, keep, slabs * n[0] * n[1])) == wanted


def test_tasks_of_umbrella_step_have_bounded_rows(spark):
    n = (3000, 5, 9000)
    assert X.umbrella_step(spark, START, LENGTHS, n, lambda vid: F.lit(1.0)).rdd.getNumPartitions() * G.TASK_ROWS >= 3001 * 6 * 9001


def test_tasks_of_boundary_faces_have_bounded_rows(spark):
    assert X.boundary_faces(spark, (20000, 1, 20000), sides=[3]).rdd.getNumPartitions() * G.TASK_ROWS >= 20000 * 20000


def test_tasks_of_boundary_cells_have_bounded_rows(spark):
    n = (3000, 5, 9000)
    assert X.is_boundary_cell(spark, n).rdd.getNumPartitions() * G.TASK_ROWS >= math.prod(n)


def test_blocks_of_vertex_means_are_spread_by_their_number(spark):
    some = spark.range(1).select((F.col("id") + 1).alias("cid"), F.lit(1.0).alias("value"))
    plan = X.vertex_means(spark, some, (3000, 5, 9000))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
