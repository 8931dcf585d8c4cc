"""Writers of mesh files. Each is one ordered file, written in ranges side by side."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.sources.ordered import Lines, write_sections


def _point(r: dict) -> str:
    return f"{r['x']:.16g} {r['y']:.16g} {r['z']:.16g}"


def _column(table: DataFrame, order: str, name: str) -> Lines:
    return table.select(order, F.col(name).alias("value")), [order], lambda r: f"{r['value']}"


def write_tri(path: str, nodes: DataFrame, cells: DataFrame, scale: float = 1.0, zero_knpr: bool = False, titles=("hexahedra", "nodes, cells and node marks")) -> None:
    """Counts, node positions, corners of cells and marks of nodes, by id."""
    sections = [
        f"{titles[0]}\n{titles[1]}\n{cells.count():8d}{nodes.count():8d} 0 8 12 6     NEL,NVT,NBCT,NVE,NEE,NAE\n DCORVG\n",
        (nodes.select("vid", *[(F.col(c) * scale).alias(c) for c in "xyz"]), ["vid"], _point),
        " KVERT\n",
        (cells.select("cid", "kvert"), ["cid"], lambda r: " ".join(map(str, r["kvert"]))),
        " KNPR\n",
        _column(nodes.withColumn("knpr", F.lit(0)) if zero_knpr else nodes, "vid", "knpr"),
    ]
    write_sections(nodes.sparkSession, path, sections)


def _vtu(path: str, points: DataFrame, order: str, cells: DataFrame, cell_order: str, ids: str, kind: int, shift: int, point_data: dict[str, str], cell_data: dict[str, str]) -> None:
    """point_data and cell_data: VTK type by column."""
    spark, n_points, n_cells = points.sparkSession, points.count(), cells.count()
    width = 3 if kind == 5 else 8
    numbers = spark.range(n_cells)

    def array(name: str, type_: str, values: Lines, components: int = 1) -> list[str | Lines]:
        extra = f' NumberOfComponents="{components}"' if components > 1 else ""
        return [f'<DataArray type="{type_}" Name="{name}"{extra} format="ascii">', values, "</DataArray>"]

    sections = [f'<?xml version="1.0"?>\n<VTKFile type="UnstructuredGrid" version="0.1" byte_order="LittleEndian">\n<UnstructuredGrid>\n<Piece NumberOfPoints="{n_points}" NumberOfCells="{n_cells}">\n<PointData>']
    for c, t in point_data.items():
        sections += array(c, t, _column(points, order, c))
    sections.append("</PointData>\n<CellData>")
    for c, t in cell_data.items():
        sections += array(c, t, _column(cells, cell_order, c))
    sections += ["</CellData>\n<Points>", *array("Points", "Float64", (points.select(order, "x", "y", "z"), [order], _point), 3), "</Points>\n<Cells>"]
    sections += array("connectivity", "Int64", (cells.select(cell_order, F.transform(ids, lambda v: v - shift).alias("ids")), [cell_order], lambda r: " ".join(map(str, r["ids"]))))
    sections += array("offsets", "Int64", (numbers, ["id"], lambda r: f"{(r['id'] + 1) * width}"))
    sections += array("types", "UInt8", (numbers, ["id"], lambda r: f"{kind}"))
    write_sections(spark, path, [*sections, "</Cells>\n</Piece>\n</UnstructuredGrid>\n</VTKFile>"])


def write_vtu_surface(path: str, sv: DataFrame, sf: DataFrame, cell_data: dict[str, str] | None = None) -> None:
    _vtu(path, sv, "vid", sf, "fid", "v", 5, 0, {}, cell_data or {})


def write_vtu_volume(path: str, nodes: DataFrame, cells: DataFrame, point_data: dict[str, str] | None = None, cell_data: dict[str, str] | None = None) -> None:
    _vtu(path, nodes, "vid", cells, "cid", "kvert", 12, 1, point_data or {}, cell_data or {})


def write_pvtu(path: str, pieces: list[str]) -> None:
    """An index of pieces that hold points and cells."""
    parts = "".join(f'<Piece Source="{p}"/>\n' for p in pieces)
    Path(path).write_text(f'<?xml version="1.0"?>\n<VTKFile type="PUnstructuredGrid" version="0.1" byte_order="LittleEndian">\n<PUnstructuredGrid GhostLevel="0">\n<PPoints><PDataArray type="Float64" Name="Points" NumberOfComponents="3"/></PPoints>\n{parts}</PUnstructuredGrid>\n</VTKFile>\n')


def write_par(path: str, nodes: DataFrame, keyword: str, parameter: str = "") -> int:
    """The ids of nodes (vid) with a keyword and a parameter string; returns how many."""
    n = nodes.count()
    write_sections(nodes.sparkSession, path, [f"{n} {keyword}\n'{parameter}'", _column(nodes, "vid", "vid")])
    return n


def write_parts(folder: str, tagged: DataFrame, keywords: dict[str, str], mesh: str = "Mesh.tri") -> list[str]:
    """A .par file for each bucket (bucket, vid) that has a keyword, and the project file that lists them."""
    names = []
    for bucket, keyword in keywords.items():
        rows = tagged.where(F.col("bucket") == bucket)
        if not rows.isEmpty():
            write_par(f"{folder}/{bucket}.par", rows, keyword)
            names.append(f"{bucket}.par")
    Path(f"{folder}/file.prj").write_text("\n".join([mesh, *names]) + "\n")
    return names


def write_xml_mesh(path: str, nodes: DataFrame, n: tuple[int, int, int], edges: DataFrame, faces: DataFrame, cells: DataFrame) -> None:
    """A mesh file with vertices and the vertex ids (v0, v1, ...) of edges, faces and cells, all counted from 0."""
    sizes = [nodes.count(), edges.count(), faces.count(), cells.count()]
    sections = [f'<FeatMeshFile version="1" mesh="conformal:hypercube:3:3">\n<Mesh type="conformal:hypercube:3:3" size="{" ".join(map(str, sizes))}">\n<Vertices>', (nodes.select("vid", "x", "y", "z"), ["vid"], _point), "</Vertices>"]
    for dim, (table, k) in enumerate(((edges, 2), (faces, 4), (cells, 8)), 1):
        corners = table.select("id", F.array(*[f"v{i}" for i in range(k)]).alias("ids"))
        sections += [f'<Topology dim="{dim}">', (corners, ["id"], lambda r: " ".join(map(str, r["ids"]))), "</Topology>"]
    write_sections(nodes.sparkSession, path, [*sections, "</Mesh>\n</FeatMeshFile>"])


def write_vector(path: str, values: DataFrame, order: str, name: str) -> None:
    """A column as a text vector: its length, then a value a line."""
    rows = values.select(order, F.col(name).cast("double").alias("value"))
    write_sections(values.sparkSession, path, [f"%%MatrixMarket matrix array real general\n{values.count()} 1", (rows, [order], lambda r: f"{r['value']:.16g}")])


def write_area(path: str, values: DataFrame) -> None:
    """One number a line, in the order of cells (cid, value)."""
    write_sections(values.sparkSession, path, [(values.select("cid", F.col("value").cast("double").alias("value")), ["cid"], lambda r: f"{r['value']:.16g}")])


def write_vtp(path: str, points: DataFrame, closed: bool = False) -> None:
    """Polylines, or polygons if closed: points (line, pos, x, y, z), in the order of their lines and places."""
    spark, tag = points.sparkSession, "Polys" if closed else "Lines"
    sizes = points.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    ends = sizes.select("line", F.sum("n").over(Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)).alias("end"))  # a row for each line
    total, lines = points.count(), sizes.count()
    array = lambda type_, name, values, extra="": [f'<DataArray type="{type_}" Name="{name}"{extra} format="ascii">', values, "</DataArray>"]
    sections = [f'<?xml version="1.0"?>\n<VTKFile type="PolyData" version="0.1" byte_order="LittleEndian">\n<PolyData>\n<Piece NumberOfPoints="{total}" NumberOf{tag}="{lines}">\n<Points>']
    sections += [*array("Float64", "Points", (points.select("line", "pos", "x", "y", "z"), ["line", "pos"], _point), ' NumberOfComponents="3"'), f"</Points>\n<{tag}>"]
    sections += [*array("Int64", "connectivity", (spark.range(total), ["id"], lambda r: f"{r['id']}")), *array("Int64", "offsets", (ends, ["line"], lambda r: f"{r['end']}"))]
    write_sections(spark, path, [*sections, f"</{tag}>\n</Piece>\n</PolyData>\n</VTKFile>"])
