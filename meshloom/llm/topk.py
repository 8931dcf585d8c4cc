"""Exact top-k by inner product: queries and candidates in cover trees, searched together.

Vectors are scaled and rounded down to integers, so scores are exact integers. The candidates' tree has three parts:

1. Cells around centres that lie farthest apart in a bounded sample of SAMPLE rows; every row goes to its nearest centre, and a
   cell's covering radius is measured over all its rows. The cells are the tree's upper nodes: CELLS at most, on the driver.
2. Blocks: a cell is cut into blocks of BLOCK_BYTES of vectors, however many rows it has; a block is a file in the shared folder.
3. In a block, a cover tree down to LEAF points or radius 0: a node covers its points within its radius, its children's centres
   lie more than half of that apart, and every point is covered within half of it by its nearest child.

Of equal vectors only the k + 1 with the smallest ids can be among anyone's best k, so that others leave before the blocks are
made, and a vector that a third of all rows share is no load. Queries are dealt into blocks in the same way; one task takes a
block of queries through all the tree. It opens cells and blocks in the order of their bounds, and walks both trees together:
a pair of nodes is pruned when its bound, from the centres' inner product and the covering radii, lies below the worst k-th score
of the node's queries, or equals it and all its ids are larger. Scores found in one block prune the next ones. Where all points
are about equally far apart, as random vectors of 64 dimensions are, a node has a child for each point and little can be pruned;
bounds of all children are then computed at once, as one product of matrices.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part, on either side; nor do rows
with a null id; vectors of different lengths only meet those of their own length; rows with equal ids are candidates one by one,
and each is a query once; vectors longer than LARGE are scored in whole-number arithmetic of any length, outside the tree, and
scores beyond 64 bits count as the largest or smallest number of 64 bits; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.common import fresh_dir, materialize, runs
from meshloom.llm.files import open_dir, replaced

K = 20
FACTOR = 64
#: Rows that the cells' centres are taken from, and the most cells of one dimension.
SAMPLE = 8192
CELLS = 1024
#: Vectors of a block of candidates, and queries of a block, at most.
BLOCK_BYTES = 4 << 20
QUERY_BLOCK = 4096
LEAF = 16
#: Tasks that blocks are dealt to, at most; a task takes its blocks one by one.
TASKS = 1 << 14
#: Inner products of vectors of at most this length are exact in double precision.
LARGE = float(1 << 26)
#: Rows of the block that bounds are computed for at once, and candidates that are scored at once.
GROUP = 256
FIRST, NEXT = 64, 4096
NONE = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max


class Tree:
    """A cover tree over the rows of points; nodes are arrays, the root is node 0."""

    FIELDS = ("points", "ids", "marks", "center", "radius", "lo", "hi", "first", "kids", "least")

    def __init__(self, **arrays: np.ndarray) -> None:
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((self.points[self.center] ** 2).sum(axis=1))
        self.exact = bool(np.isinf(self.radius[0]))

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray, marks: np.ndarray, flat: bool = False) -> Tree:
        """flat: one node that holds all rows, as no bounds are computed for large vectors."""
        order = np.lexsort((marks, ids))
        points, ids, marks = points[order], ids[order], marks[order]
        place = np.arange(len(points))  # rows in the order of the tree
        center, radius, lo, hi, first, kids = [0], [math.inf if flat else _gaps(points, points[:1])[:, 0].max(initial=0.0)], [0], [len(points)], [0], [0]
        at = 0
        while at < len(center) and not flat:
            a, b, r = lo[at], hi[at], radius[at] / 2
            if b - a > LEAF and r > 0:
                rows = place[a:b]
                chosen, owner, gap = _cover(points, rows, center[at], r)
                by = np.argsort(owner, kind="stable")
                place[a:b] = rows[by]
                ends = np.cumsum(np.bincount(owner, minlength=len(chosen)))
                first[at], kids[at] = len(center), len(chosen)
                far = np.zeros(len(chosen))
                np.maximum.at(far, owner, gap)
                center += chosen.tolist()
                radius += far.tolist()
                lo += (a + np.concatenate([[0], ends[:-1]])).tolist()
                hi += (a + ends).tolist()
                first += [0] * len(chosen)
                kids += [0] * len(chosen)
            at += 1
        where = np.empty(len(place), np.int64)
        where[place] = np.arange(len(place))
        lo, hi, ids = np.array(lo), np.array(hi), ids[place]
        least = np.array([ids[a:b].min(initial=MOST) for a, b in zip(lo, hi, strict=True)])
        return cls(points=points[place], ids=ids, marks=marks[place], center=where[np.array(center)], radius=np.array(radius), lo=lo, hi=hi, first=np.array(first), kids=np.array(kids), least=least)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as arrays:
            return cls(**{name: arrays[name] for name in cls.FIELDS})

    def centers(self, nodes: np.ndarray) -> np.ndarray:
        return self.points[self.center[nodes]]

    def children(self, nodes: np.ndarray) -> np.ndarray:
        return np.repeat(self.first[nodes], self.kids[nodes]) + steps(self.kids[nodes])

    def rows(self, nodes: np.ndarray) -> np.ndarray:
        n = self.hi[nodes] - self.lo[nodes]
        return np.repeat(self.lo[nodes], n) + steps(n)


def steps(count: np.ndarray) -> np.ndarray:
    """0..n-1 for each n in turn."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows; exact squares, as components are whole numbers and lengths at most LARGE."""
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T), 0.0))


def _cover(points: np.ndarray, rows: np.ndarray, center: int, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres among rows, the first being center, that lie more than r apart and cover all rows within r; each row's centre and gap."""
    chosen = [center]
    gap = _gaps(points[rows], points[center : center + 1])[:, 0]
    owner = np.zeros(len(rows), np.int64)
    left = np.flatnonzero(gap > r)
    while len(left):
        some = left[:GROUP]
        among = _gaps(points[rows[some]], points[rows[some]])
        free, new = np.ones(len(some), bool), []
        for i in range(len(some)):
            if free[i]:
                new.append(i)
                free &= among[i] > r
        at = np.array(new)
        for part in (left[i : i + NEXT] for i in range(0, len(left), NEXT)):
            d = _gaps(points[rows[part]], points[rows[some[at]]])
            best = d.argmin(axis=1)
            near = d[np.arange(len(part)), best]
            closer = near < gap[part]
            gap[part[closer]], owner[part[closer]] = near[closer], len(chosen) + best[closer]
        chosen += rows[some[at]].tolist()
        left = left[gap[left] > r]
    return np.array(chosen), owner, gap


class Best:
    """The best k of each query: scores and ids, kept in order; and how many pairs of points were scored, and bounds of nodes made."""

    def __init__(self, n: int, k: int) -> None:
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), MOST)
        self.scored = self.bounded = 0

    def worst(self, rows: slice | np.ndarray) -> tuple[int, int]:
        """The worst k-th score of the rows, and the largest id that stands there."""
        last, ids = self.score[rows, -1], self.id[rows, -1]
        low = last.min()
        return int(low), int(ids[last == low].max())

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """scores (queries x candidates) of the queries in rows; own marks what is the query itself."""
        k = self.score.shape[1]
        self.scored += scores.size
        last = self.score[rows, k - 1][:, None]
        better = ((scores > last) | ((scores == last) & (ids[None, :] < self.id[rows, k - 1][:, None]))) & ~own
        for i in np.flatnonzero(better.any(axis=1)):
            r, there = rows[i], np.flatnonzero(better[i])
            s, x = np.concatenate([self.score[r], scores[i, there]]), np.concatenate([self.id[r], ids[there]])
            if len(s) > 4 * k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                s, x = s[s >= least], x[s >= least]
            top = np.lexsort((x, ~s))[:k]
            self.score[r], self.id[r] = s[top], x[top]


def scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as whole numbers; exact: by arithmetic of any length, cut to 64 bits."""
    if not exact:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)


def limits(dots: np.ndarray, q_norm: np.ndarray, q_radius: np.ndarray, norm: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The most that a query of each node (rows) scores with a candidate of each other (columns), from their centres' products."""
    q_norm, q_radius = q_norm[:, None], q_radius[:, None]
    rounding = 1e-9 + 1e-12 * (q_norm + q_radius) * (norm + radius)
    return np.floor(dots + q_radius * norm + radius * q_norm + q_radius * radius + rounding)


def search(q: Tree, c: Tree, best: Best) -> None:
    """Offers to best, for each row of q, the rows of c that may be among its best."""
    if not len(q.points) or not len(c.points):
        return
    if q.exact or c.exact:
        for a in range(0, len(q.points), GROUP):
            rows = np.arange(a, min(a + GROUP, len(q.points)))
            best.offer(rows, scores(q.points[rows], c.points, True), c.ids, q.marks[rows][:, None] == c.marks[None, :])
        return

    def bounds(qs: np.ndarray, cs: np.ndarray) -> np.ndarray:
        best.bounded += len(qs) * len(cs)
        return limits(q.centers(qs) @ c.centers(cs).T, q.norm[qs], q.radius[qs], c.norm[cs], c.radius[cs])

    def left_open(node: int, cs: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the worst of the node's queries leaves of cs."""
        score, worst_id = best.worst(slice(q.lo[node], q.hi[node]))
        keep = (b > score) | ((b == score) & (c.least[cs] <= worst_id))
        return cs[keep], b[keep]

    def score_leaf(node: int, cs: np.ndarray, b: np.ndarray) -> None:
        """A leaf of queries with leaves of candidates, the best bounds first."""
        rows, size = np.arange(q.lo[node], q.hi[node]), FIRST
        while len(cs):
            n = min(len(cs), max(1, size // int((c.hi[cs] - c.lo[cs]).max())))
            top = np.argpartition(-b, n - 1)[:n]
            for there in np.array_split(found := c.rows(cs[top]), -(-len(found) // NEXT)):
                best.offer(rows, scores(q.points[rows], c.points[there], False), c.ids[there], q.marks[rows][:, None] == c.marks[there][None, :])
            rest = np.ones(len(cs), bool)
            rest[top] = False
            cs, b = left_open(node, cs[rest], b[rest])
            size = NEXT

    def walk(node: int, cs: np.ndarray, b: np.ndarray) -> None:
        """A node of queries with nodes of candidates: opens those of them that are no smaller, then itself; radii halve with depth."""
        cs, b = left_open(node, cs, b)
        leaf = q.kids[node] == 0
        while len(cs) and (inner := (c.kids[cs] > 0) & (leaf | (c.radius[cs] >= q.radius[node]))).any():
            new = c.children(cs[inner])
            b = np.concatenate([b[~inner], bounds(np.array([node]), new)[0]])
            cs, b = left_open(node, np.concatenate([cs[~inner], new]), b)
        if leaf:
            score_leaf(node, cs, b)
        elif len(cs):
            kids = q.children(np.array([node]))
            for some in (kids[i : i + GROUP] for i in range(0, len(kids), GROUP)):
                for kid, row in zip(some, bounds(some, cs), strict=True):
                    walk(kid, cs, row)

    root = np.zeros(1, np.int64)
    walk(0, root, bounds(root, root)[0])


def vectors(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", factor: float = FACTOR) -> DataFrame:
    """(vec_id, v, dim): rows that take part, with whole numbers as components."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where("vec_id IS NOT NULL")
    ok = rows.where((F.size("x") > 0) & ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # beyond 2^52 every double is a whole number; the largest stay finite
    whole = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x * float(factor)).cast("double")).otherwise(F.greatest(F.least(x * float(factor), F.lit(1.7e308)), F.lit(-1.7e308)))
    return ok.select("vec_id", F.transform("x", whole).alias("v"), F.size("x").alias("dim"))


def _centers(rows: DataFrame, n: dict[int, int]) -> dict[int, np.ndarray]:
    """Centres of the cells of each dimension: of a sample, each the farthest from those before it; the origin where there is none."""
    out = {dim: np.zeros((1, dim)) for dim in n}
    sample = rows.where("NOT large").orderBy(F.xxhash64("v", "vec_id")).limit(SAMPLE).select("dim", "v").toArrow()
    dims = sample.column("dim").to_numpy()
    for dim in np.unique(dims):
        points = _matrix(sample.column("v").combine_chunks().filter(pa.array(dims == dim)), int(dim))
        wanted = min(CELLS, math.ceil(n[int(dim)] / _block_rows(int(dim))))
        chosen, gap = [0], _gaps(points, points[:1])[:, 0]
        while len(chosen) < wanted and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, _gaps(points, points[chosen[-1:]])[:, 0])
        out[int(dim)] = points[chosen]
    return out


def _block_rows(dim: int) -> int:
    return max(64, BLOCK_BYTES // (8 * dim))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _with_cells(rows: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """Adds cell, -1 for large vectors, and gap, the distance from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, large = batch.column("dim").to_numpy(), batch.column("large").to_numpy(zero_copy_only=False)
            cell, gap = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for dim in np.unique(dims):
                at = np.flatnonzero((dims == dim) & ~large)
                for part in (at[i : i + NEXT] for i in range(0, len(at), NEXT)):
                    d = _gaps(_matrix(batch.column("v").take(pa.array(part)), int(dim)), centers[int(dim)])
                    cell[part] = d.argmin(axis=1)
                    gap[part] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], names=[*batch.schema.names, "cell", "gap"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, cell int, gap double")


def _numbered(rows: DataFrame, size) -> tuple[DataFrame, list[tuple[int, int, float, int, int]]]:
    """Deals rows into blocks, a cell's rows into as many as it needs, and the cells: (dim, cell, radius, first block, blocks)."""
    found = rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).orderBy("dim", "cell").collect()  # CELLS rows a dimension
    cells, at = [], 0
    for r in found:
        n = math.ceil(r["n"] / size(r["dim"]))
        cells.append((r["dim"], r["cell"], r["radius"], at, n))
        at += n
    table = rows.sparkSession.createDataFrame([(d, c, a, n) for d, c, _, a, n in cells] or [(0, 0, 0, 1)], "dim int, cell int, first long, blocks long")
    block = F.col("first") + F.pmod(F.xxhash64("mark"), F.col("blocks"))
    return rows.join(F.broadcast(table), ["dim", "cell"]).select(block.cast("int").alias("block"), "dim", "cell", "vec_id", "mark", "v"), cells


def _tree(parts: Iterator[pa.RecordBatch]) -> Tree:
    """The tree over a block's rows."""
    table = pa.Table.from_batches(list(parts))
    points = _matrix(table.column("v"), table.column("dim")[0].as_py())
    return Tree.build(points, table.column("vec_id").to_numpy(), table.column("mark").to_numpy(), table.column("cell")[0].as_py() < 0)


def index(rows: DataFrame, uri: str, centers: dict[int, np.ndarray], k: int) -> list[tuple[int, int, float, int, int]]:
    """Writes the candidates' blocks below uri; returns the cells (dim, cell, radius, first block, blocks)."""
    same = Window.partitionBy("h", "v").orderBy("vec_id", "mark")
    some = rows.withColumn("h", F.xxhash64("v")).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).drop("h", "r")
    placed = materialize(_with_cells(some, centers), "cells")
    dealt, cells = _numbered(placed, _block_rows)
    n = sum(x[4] for x in cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_dir(uri)
        for block, parts in runs(batches):
            data = _tree(parts).dump()
            with replaced(system, f"{folder}/{block}.npz") as out:
                out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32())], names=["block"])

    if n:
        done = dealt.repartitionById(min(n, TASKS), F.col("block")).sortWithinPartitions("block").mapInArrow(run, "block int")
        if done.count() != n:
            raise RuntimeError("blocks of the index are missing")
    return cells


def top_k(table: DataFrame, k: int = K, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries, whose id is divisible by `every`."""
    spark = table.sparkSession
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = vectors(table).withColumn("large", length > LARGE**2).withColumn("mark", F.monotonically_increasing_id())
    rows = materialize(rows, "vectors")
    n = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each dimension
    uri, schema = fresh_dir(spark, "cover-trees"), "query_id long, rank int, vec_id long, score long"
    centers = _centers(rows, n)
    cells = index(rows, uri, centers, k)
    queries = materialize(_with_cells(rows.where(F.pmod("vec_id", F.lit(every)) == 0), centers), "queries")
    # blocks small enough for every core to have some, however few queries there are
    size = min(QUERY_BLOCK, max(GROUP, math.ceil(queries.count() / (4 * spark.sparkContext.defaultParallelism))))
    dealt, groups = _numbered(queries, lambda _: size)
    n_groups = sum(x[4] for x in groups)
    if not n_groups:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_dir(uri)
        for _, parts in runs(batches):
            tree = _tree(parts)
            best = Best(len(tree.points), k)
            for block in candidates(tree, best):
                with system.open_input_file(f"{folder}/{block}.npz") as file:
                    search(tree, Tree.load(file.read()), best)
            i, j = np.nonzero(best.score > NONE)
            yield pa.RecordBatch.from_arrays([pa.array(tree.ids[i]), pa.array((j + 1).astype(np.int32)), pa.array(best.id[i, j]), pa.array(best.score[i, j])], names=["query_id", "rank", "vec_id", "score"])

    def candidates(tree: Tree, best: Best) -> Iterator[int]:
        """The blocks of the cells that the queries' worst k-th score leaves open, best bounds first."""
        dim = tree.points.shape[1]
        own = [x for x in cells if x[0] == dim]
        at, r = np.array([x[1] for x in own]), np.array([x[2] for x in own])
        there = centers[dim][np.maximum(at, 0)]
        root = np.zeros(1, np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            b = limits(tree.centers(root) @ there.T, tree.norm[root], tree.radius[root], np.sqrt((there**2).sum(axis=1)), r)[0]
        b = np.where((at < 0) | tree.exact, np.inf, b)
        for i in np.argsort(-b, kind="stable"):
            for block in range(own[i][3], own[i][3] + own[i][4]):
                if b[i] >= best.worst(slice(None))[0]:
                    yield block

    return dealt.repartitionById(min(n_groups, TASKS), F.col("block")).sortWithinPartitions("block").mapInArrow(run, schema)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op10(table: DataFrame) -> DataFrame:
    return top_k(table)
