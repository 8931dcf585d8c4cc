"""Histograms over streams of surface files: each batch of new cases is analysed as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STAGE = r"^\s*\[(?<stage>[A-Za-z]+)\]\s*(?<state>start|done|failed)\s+(?<case>\S+)"


def stage_events(spark: SparkSession, folder: str) -> DataFrame:
    """(case, stage, state) of the marker lines that running cases append to logs in a folder, as a stream."""
    text = spark.readStream.text(folder)
    found = [F.regexp_extract("value", STAGE.replace("?<stage>", "").replace("?<state>", "").replace("?<case>", ""), i) for i in (3, 1, 2)]
    return text.select(*[c.alias(n) for c, n in zip(found, ("case", "stage", "state"), strict=True)]).where("case <> ''")


def stage_counts(events: DataFrame) -> DataFrame:
    """(stage, state, n), updated as events come."""
    return events.groupBy("stage", "state").agg(F.count(F.lit(1)).alias("n"))


def for_each_batch(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs an operator on each batch of a stream, once, from its checkpoint on."""
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
