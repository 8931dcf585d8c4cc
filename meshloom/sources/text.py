"""Lines of text files with their numbers, and formats of keys and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of a file, numbered from 0, read in parallel.

    Line ids grow within a block of the file; blocks are counted, and a block's lines start where the blocks before it end.
    """
    raw = spark.read.text(path).select(F.input_file_block_start().alias("b"), F.monotonically_increasing_id().alias("i"), "value")
    counts = raw.groupBy("b").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block
    base = counts.select("b", "first", before.alias("base"))
    return raw.join(F.broadcast(base), "b").select((F.col("i") - F.col("first") + F.col("base")).alias("n"), "value")


def fields(value: str = "value"):
    return F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")


def settings(text: DataFrame, comments: str = "#;") -> DataFrame:
    """(section, key, value) of lines (n, value) with [sections] and key = value pairs; names are lower-cased, comments cut.

    A key belongs to the last section header above it.
    """
    cut = F.trim(F.regexp_replace("value", f"[{comments}].*$", ""))
    rows = text.select("n", cut.alias("line")).where("line <> ''")
    header = F.nullif(F.lower(F.trim(F.regexp_extract("line", r"^\[(.*)\]$", 1))), F.lit(""))
    section = F.last(header, ignorenulls=True).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))  # a settings file
    rows = rows.withColumn("section", section).where("line NOT LIKE '[%' AND line LIKE '%=%'")
    return rows.select("n", "section", F.lower(F.trim(F.regexp_extract("line", r"^([^=]*)=", 1))).alias("key"), F.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1)).alias("value"))


def histogram_percents(text: DataFrame) -> DataFrame:
    """(n, label, pct): lines of a monitor summary, such as `bin 0 : 12.5 %`."""
    found = F.regexp_extract("value", r"([0-9]+(?:\.[0-9]+)?)\s*%", 1)
    return text.where(found != "").select("n", F.trim(F.regexp_extract("value", r"^([^:=]*)[:=]", 1)).alias("label"), found.cast("double").alias("pct"))
