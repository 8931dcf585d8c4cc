"""What the operators share: words, folders, written intermediate tables, distributed running totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshloom.sources.shared import fresh_dir  # noqa: F401
from meshloom.sources.shared import written as materialize

#: A word is a run of other characters than ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one window group of a running total holds on average.
ROWS_PER_BUCKET = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hash60(*columns: Column | str) -> Column:
    """A hash in [0, 2^60) of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 4)


def running_total(rows: DataFrame, by: str, at: str, ties: list[str], value: str, sizes: DataFrame, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows of the same group `by` that come earlier in the order of (at, ties).

    at is in [0, 2^60) and spread evenly, as hashes are. sizes has one row (by, n_rows) per group. Each group's line is cut into
    buckets of about ROWS_PER_BUCKET rows; buckets are summed first, and windows run within a bucket and over the buckets' sums
    only, so that a group with a third of all rows is spread over many tasks. by must not be null.
    """
    width = sizes.select(by, F.ceil(F.lit(float(1 << 60)) / F.ceil(F.col("n_rows") / ROWS_PER_BUCKET)).cast("long").alias("__width"))
    cut = rows.join(width, by).withColumn("__bucket", F.floor(F.col(at) / F.col("__width"))).drop("__width")
    sums = cut.groupBy(by, "__bucket").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(by, "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(by, "__bucket").orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, -1)
    within = cut.withColumn("__within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return within.join(base, [by, "__bucket"]).withColumn(out, F.col("__base") + F.col("__within")).drop("__base", "__within", "__bucket")


def ordered_totals(rows: DataFrame, order: list[str], totals: dict[str, str]) -> DataFrame:
    """Adds each out of totals (out: value): the sum of value over the rows that come earlier in the order.

    Rows are written, cut into ranges, ranges are summed, and windows run within a range. Rows must differ in the order's columns.
    """
    spark = rows.sparkSession
    cut = materialize(rows.repartitionByRange(spark.sparkContext.defaultParallelism, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = {r["__range"]: r for r in cut.groupBy("__range").agg(*[F.sum(value).alias(out) for out, value in totals.items()]).collect()}  # a row for each range
    base, at = [], {out: 0.0 if cut.schema[value].dataType.typeName() == "double" else 0 for out, value in totals.items()}
    for k in sorted(sums):
        base.append((k, *at.values()))
        at = {out: n + sums[k][out] for out, n in at.items()}
    kinds = ", ".join(f"`__{out}` {cut.schema[value].dataType.simpleString()}" for out, value in totals.items())
    bases = spark.createDataFrame(base, f"__range int, {kinds}")
    inner = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumns({out: F.coalesce(F.sum(value).over(inner), F.lit(0)) for out, value in totals.items()}).join(F.broadcast(bases), "__range")
    return out.withColumns({out: F.col(out) + F.col(f"__{out}") for out in totals}).drop("__range", *[f"__{out}" for out in totals])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Sorted batches by their first column: (value, iterator of batches)."""
    state: dict = {"rest": None, "batches": iter(batches)}

    def next_batch() -> pa.RecordBatch | None:
        b = state["rest"] if state["rest"] is not None else next(state["batches"], None)
        state["rest"] = None
        return b if b is None or b.num_rows else next_batch()

    def rows(value: int):
        while (b := next_batch()) is not None:
            own = b.column(0).to_numpy()
            n = int(np.searchsorted(own, value, "right"))
            if n < len(own):
                state["rest"] = b.slice(n)
            if n:
                yield b.slice(0, n)
            if n < len(own):
                return

    while (b := next_batch()) is not None:
        state["rest"] = b
        value = b.column(0)[0].as_py()
        yield value, rows(value)


def slices(batch: pa.RecordBatch, column: int = 1, rows: int = 1000, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows, and of at most so many bytes in a text column unless a single text has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right"))
        stop = max(start + 1, min(stop, start + rows))
        yield batch.slice(start, stop - start)
        start = stop


def row_numbers() -> Iterator[int]:
    """Numbers that no other task of the stage gives; a table that holds them must be written before it is read twice."""
    start = TaskContext.get().partitionId() << 33
    return iter(range(start, start + (1 << 33)))


def frequent(table: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of table with the largest n, at most `most` of them: whole classes of about equal n, so that one pass of counts finds them."""
    kind = F.floor(8 * F.log2(F.greatest(F.col(n), F.lit(1)).cast("double")))
    left, least = most, 1 << 30
    for k, rows in sorted(((r[0], r[1]) for r in table.groupBy(kind.alias("kind")).agg(F.count(F.lit(1))).collect()), reverse=True):  # at most 8 * 63 rows
        if rows > left:
            break
        left, least = left - rows, k
    return table.where(kind >= least)


class Lookup:
    """Rows of sorted whole numbers: `find` gives the row of each key and whether it is there."""

    def __init__(self, keys: np.ndarray) -> None:
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.order[at], self.keys[at] == keys


def lists(values: np.ndarray, groups: np.ndarray, n: int) -> pa.ListArray:
    """An Arrow list for each of n groups; values lie together by group."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(groups, np.arange(n + 1)).astype(np.int32)), pa.array(values))
