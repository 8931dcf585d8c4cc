"""One text file in a given order, written by many tasks: a data source for lines.

Lines are dealt into ranges of their order. Each task writes its range to a file of its own beside the target and reports its place
and length; the commit lays the files out one after the other, whole files at a time, and puts the result in the target's place. A
task that runs again writes another file; what the commit doesn't name is removed with the others of an attempt that failed.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: A table with the columns of its order, and what makes a line of a row.
Lines = tuple[DataFrame, list[str], Callable[[dict], str]]


@dataclass
class Part(WriterCommitMessage):
    place: int
    path: str
    size: int


class OrderedWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator) -> Part:
        part = f"{self.path}.{uuid.uuid4().hex}.part"
        with open(part, "w", encoding="utf-8") as f:
            for row in iterator:
                f.write(row["line"])
                f.write("\n")
        return Part(TaskContext.get().partitionId(), part, os.path.getsize(part))

    def commit(self, messages: list[Part | None]) -> None:
        whole = f"{self.path}.{uuid.uuid4().hex}.tmp"
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        with open(whole, "wb") as out:
            at = 0
            for m in parts:
                with open(m.path, "rb") as f:
                    left = m.size
                    while left:  # by the operating system, from file to file
                        left -= os.sendfile(out.fileno(), f.fileno(), m.size - left, left)
                at += m.size
            if os.path.getsize(whole) != at:
                raise OSError(f"{whole} has not the length of its parts")
        os.replace(whole, self.path)
        for m in parts:
            os.remove(m.path)

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class OrderedLines(DataSource):
    """`df.write.format("ordered_lines").mode("append").save(path)` for a table (line) whose partitions are in order."""

    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> OrderedWriter:
        return OrderedWriter(self.options["path"])


def _lines(number: int, section: str | Lines, spark: SparkSession) -> DataFrame:
    """(section, p0, p1, line)."""
    if isinstance(section, str):
        rows = section.removesuffix("\n").split("\n")
        return spark.createDataFrame([(number, i, 0, x) for i, x in enumerate(rows)], "section int, p0 long, p1 long, line string")
    table, order, text = section

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([text(r) for r in batch.to_pylist()], pa.string())
            places = [batch.column(c).cast(pa.int64()) for c in order] + [pa.array([0] * batch.num_rows, pa.int64())] * (2 - len(order))
            yield pa.RecordBatch.from_arrays([pa.array([number] * batch.num_rows, pa.int32()), *places, own], names=["section", "p0", "p1", "line"])

    return table.mapInArrow(run, "section int, p0 long, p1 long, line string")


def write_sections(spark: SparkSession, path: str | Path, sections: list[str | Lines]) -> None:
    """A file of sections one after the other: texts as they are, and tables by their one or two columns of order."""
    spark.dataSource.register(OrderedLines)
    lines = reduce(DataFrame.union, [_lines(i, x, spark) for i, x in enumerate(sections)])
    order = [F.col(c) for c in ("section", "p0", "p1")]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.format("ordered_lines").mode("append").save(str(path))
