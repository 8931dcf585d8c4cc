"""Readers of mesh files: .tri volumes, OFF and VTU surfaces and volumes, per-cell values."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.sources.text import fields, lines

#: Names of the numbers in the third line of a .tri file, and of its sections.
HEADER = ("nel", "nvt", "nbct", "nve", "nee", "nae")
SECTIONS = ("DCORVG", "KVERT", "KNPR")
VTK_TRIANGLE, VTK_HEXAHEDRON = 5, 12


def tri_counts(text: DataFrame) -> dict[str, int]:
    """The header of a .tri file."""
    row = text.where("n = 2").select(fields().alias("f")).first()
    if row is None:
        raise ValueError("no header")
    return {k: int(v) for k, v in zip(HEADER, row["f"], strict=False)}


def read_tri(spark: SparkSession, path: str) -> tuple[dict[str, int], DataFrame, DataFrame]:
    """Header, nodes (vid, x, y, z, knpr) and cells (cid, kvert) of a .tri file; ids count from 1."""
    text = lines(spark, path)
    head = tri_counts(text)
    tags = {r["value"].strip().upper(): r["n"] for r in text.where(F.upper(F.trim("value")).isin(*SECTIONS)).collect()}
    missing = [s for s in SECTIONS if s not in tags]
    if missing:
        raise ValueError(f"no section {', '.join(missing)}")

    def section(name: str, n: int) -> DataFrame:
        rows = text.where((F.col("n") > tags[name]) & (F.col("n") <= tags[name] + n))
        return rows.select((F.col("n") - tags[name]).alias("id"), fields().alias("f"))

    xyz = section("DCORVG", head["nvt"]).select(F.col("id").alias("vid"), *[F.col("f")[i].try_cast("double").alias(c) for i, c in enumerate("xyz")])
    knpr = section("KNPR", head["nvt"]).select(F.col("id").alias("vid"), F.col("f")[0].try_cast("int").alias("knpr"))
    cells = section("KVERT", head["nel"]).select(F.col("id").alias("cid"), F.transform("f", lambda v: v.try_cast("long")).alias("kvert"))
    return head, xyz.join(knpr, "vid"), cells


def read_off(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) and triangles (fid, v) of an OFF file; ids count from 0, polygons are cut into fans."""
    text = lines(spark, path).select("n", F.trim(F.regexp_replace("value", "#.*$", "")).alias("value")).where("value <> ''")
    first = text.orderBy("n").limit(2).collect()
    if not first or not first[0]["value"].upper().startswith("OFF"):
        raise ValueError("not an OFF file")
    rest = first[0]["value"][3:].strip()
    counts, start = (rest, first[0]["n"]) if rest else (first[1]["value"], first[1]["n"])
    nv, nf = (int(x) for x in counts.split()[:2])
    if not nv or not nf:
        raise ValueError("an empty surface")
    # blank lines and comments don't count, so lines are numbered anew
    body = text.where(F.col("n") > start)
    from meshloom.operators.topology import dense_ids

    rows = dense_ids(body, ["n"], "k", 0).select("k", fields().alias("f"))
    sv = rows.where(F.col("k") < nv).select(F.col("k").alias("vid"), *[F.col("f")[i].try_cast("double").alias(c) for i, c in enumerate("xyz")])
    polygons = rows.where((F.col("k") >= nv) & (F.col("k") < nv + nf)).select(F.col("k").alias("p"), F.transform(F.slice("f", F.lit(2), F.col("f")[0].try_cast("int")), lambda v: v.try_cast("long")).alias("q"))
    fans = polygons.where(F.size("q") >= 3).select("p", "q", F.explode(F.sequence(F.lit(1), F.size("q") - 2)).alias("i"))
    tri = fans.select("p", "i", F.array(F.col("q")[0], F.get("q", F.col("i")), F.get("q", F.col("i") + 1)).alias("v"))
    return sv, dense_ids(tri, ["p", "i"], "fid", 0).select("fid", "v")


#: Number types of VTU arrays; unsigned ones widen a step.
TYPES = {"Int8": "int8", "UInt8": "int16", "Int16": "int16", "UInt16": "int32", "Int32": "int32", "UInt32": "int64", "Int64": "int64", "UInt64": "object", "Float32": "float32", "Float64": "float64"}


def _array(node: ET.Element) -> np.ndarray:
    if node.get("format", "ascii") != "ascii":
        raise ValueError(f"array {node.get('Name')} isn't written as text")
    kind = TYPES[node.get("type", "Float64")]
    words = (node.text or "").split()
    data = np.array([int(w) for w in words], dtype=object) if kind == "object" else np.array(words, dtype=np.float64 if "float" in kind else np.int64).astype(kind)
    width = int(node.get("NumberOfComponents", "1"))
    return data.reshape(-1, width) if width > 1 else data


def _vtu(spark: SparkSession, path: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, dict, dict]:
    """Points, cells, cell types, point and cell arrays of a one-piece VTU file."""
    content = spark.read.format("binaryFile").load(path).select("content").first()
    if content is None:
        raise ValueError(f"no file {path}")
    piece = ET.parse(io.BytesIO(content["content"])).getroot().find(".//Piece")
    if piece is None:
        raise ValueError("no piece")

    def arrays(tag: str) -> dict[str, np.ndarray]:
        found = piece.find(tag)
        return {} if found is None else {a.get("Name", ""): _array(a) for a in found.iter("DataArray")}

    points = next(iter(arrays("Points").values())).reshape(-1, 3)
    cells = arrays("Cells")
    ends = cells["offsets"].astype(int)
    return points, np.split(cells["connectivity"], ends[:-1]), cells["types"], arrays("PointData"), arrays("CellData")


def _frame(spark: SparkSession, columns: dict) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({k: list(v) if getattr(v, "ndim", 1) > 1 else v for k, v in columns.items()}))


def read_vtu_surface(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles (fid, v and one column for each cell array) of a VTU file of triangles."""
    points, cells, types, _, data = _vtu(spark, path)
    if not len(cells) or (types != VTK_TRIANGLE).any():
        raise ValueError("not a surface of triangles")
    sv = _frame(spark, {"vid": np.arange(len(points)), **{c: points[:, i].astype(float) for i, c in enumerate("xyz")}})
    return sv, _frame(spark, {"fid": np.arange(len(cells)), "v": [x.astype(int).tolist() for x in cells], **data})


def read_vtu_volume(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (vid, x, y, z, knpr) and cells (cid, kvert, monitor) of a VTU file of hexahedra; arrays that are missing are 0."""
    points, cells, types, at_points, at_cells = _vtu(spark, path)
    if not len(cells) or (types != VTK_HEXAHEDRON).any():
        raise ValueError("not a volume of hexahedra")
    knpr = at_points.get("KNPR", np.zeros(len(points), np.int32))
    monitor = at_cells.get("monitor", np.zeros(len(cells), np.int32))
    nodes = _frame(spark, {"vid": np.arange(1, len(points) + 1), **{c: points[:, i].astype(float) for i, c in enumerate("xyz")}, "knpr": knpr.astype(np.int32)})
    return nodes, _frame(spark, {"cid": np.arange(1, len(cells) + 1), "kvert": [(x.astype(int) + 1).tolist() for x in cells], "monitor": monitor})


def read_surface(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles by the file's extension."""
    kind = PurePosixPath(path).suffix.lower()
    if kind == ".off":
        return read_off(spark, path)
    if kind == ".vtu":
        return read_vtu_surface(spark, path)
    raise ValueError(f"no reader for {kind}")


def read_area(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """(cid, value): the number in a cell's line; cells beyond the end have 0."""
    values = lines(spark, path).select((F.col("n") + 1).alias("cid"), F.trim("value").try_cast("double").alias("value"))
    return cells.select("cid").join(values, "cid", "left").select("cid", F.coalesce("value", F.lit(0.0)).alias("value"))


def find_cases(spark: SparkSession, root: str, needed: tuple[str, ...] = ()) -> DataFrame:
    """(case): folders below root that hold all needed files, sorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    names = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("case"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    have = names.groupBy("case").agg(F.collect_set("name").alias("names"))
    want = F.array(*[F.lit(x) for x in needed]) if needed else F.array().cast("array<string>")
    return have.where(F.size(F.array_except(want, "names")) == 0).select("case").orderBy("case")
