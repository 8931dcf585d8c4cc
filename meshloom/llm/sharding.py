"""Shards by extendible hashing: a directory over hash prefixes in which only oversized buckets are split on another bit.

Native: DataFrame functions only. The hash of a document is 40 bits of the md5 of its doc_id and 20 of that of its text, so rows
that share an id split as well. Bytes are summed by prefix at a depth that is surely deep enough (it grows until no oversized
bucket is left that another bit could split), rolled up to all shallower prefixes, and a document's shard is the prefix one bit
longer than its last oversized one: sums only, whatever the number of documents.

Defined results: a null doc_id and a null text hash as empty, and a null text has 0 bytes; equal rows cannot be told apart and
share a shard, which may then exceed the limit, as may a shard of a single larger document; an empty table gives no rows; other
columns are carried along by `write_shards` and ignored by `shard`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import materialize

LIMIT_BYTES = 512 << 10
ID_BITS = 40
TEXT_BITS = 20
BITS = ID_BITS + TEXT_BITS
#: Bits beyond the even depth at first, and more bits each time that is too few.
SPARE_BITS = 6


def bucket_hash(doc_id: Column, text: Column) -> Column:
    def bits(x: Column, n: int) -> Column:
        return F.conv(F.substring(F.md5(F.coalesce(x.cast("string"), F.lit(""))), 1, n // 4), 16, 10).cast("long")

    return bits(doc_id, ID_BITS) * (1 << TEXT_BITS) + bits(text, TEXT_BITS)


def directory(hashed: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """(leaf, shard, depth, shard_bytes) for every prefix of `deep` bits that occurs in hashed (h, bytes), and deep."""
    total = hashed.agg(F.sum("bytes")).first()[0] or 0
    deep = min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + SPARE_BITS)
    while True:
        leaves = hashed.groupBy(F.shiftright("h", BITS - deep).alias("leaf")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        leaves = materialize(leaves, "leaves")
        if deep == BITS or leaves.where((F.col("bytes") > limit) & (F.col("lo") < F.col("hi"))).isEmpty():
            break
        deep = min(BITS, deep + SPARE_BITS)
    paths = leaves.select("*", F.explode(F.sequence(F.lit(0), F.lit(deep))).alias("d")).withColumn("p", F.expr(f"shiftright(leaf, {deep} - d)"))
    split = paths.groupBy("d", "p").agg(F.sum("bytes").alias("b"), F.min("lo").alias("l"), F.max("hi").alias("h")).where((F.col("b") > limit) & (F.col("l") < F.col("h"))).select("d", "p")
    # prefixes above an oversized one are oversized too, so their number is the depth
    depth = paths.select("leaf", "d", "p").join(split, ["d", "p"]).groupBy("leaf").agg(F.count(F.lit(1)).cast("int").alias("depth"))
    placed = leaves.select("leaf", "bytes").join(depth, "leaf", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    prefix = F.expr(f"shiftright(leaf, {deep} - depth)")
    placed = placed.withColumn("shard", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), F.col("depth"), F.lit("0"))))
    sums = placed.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"))
    return materialize(placed.join(sums, "shard").select("leaf", "shard", "depth", "shard_bytes"), "directory"), deep


def shard(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """(doc_id, h, bytes, shard, depth, shard_bytes): shard is the prefix of the hash as a string of bits, empty for the whole."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = materialize(docs.select("doc_id", bucket_hash(F.col("doc_id"), text).alias("h"), F.octet_length(text).cast("long").alias("bytes")), "hashed")
    found, deep = directory(hashed, limit)
    return hashed.withColumn("leaf", F.shiftright("h", BITS - deep)).join(found, "leaf").drop("leaf")


def write_shards(docs: DataFrame, uri: str, limit: int = LIMIT_BYTES) -> DataFrame:
    """Writes docs below uri as Parquet, one folder per shard, with all columns; returns the shards (shard, depth, shard_bytes)."""
    found = shard(docs, limit).select("h", "shard", "depth", "shard_bytes").distinct()
    found = materialize(found, "placed")
    rows = docs.withColumn("__meshloom_h", bucket_hash(F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))))
    joined = rows.join(found.select(F.col("h").alias("__meshloom_h"), F.col("shard").alias("__meshloom_shard")), "__meshloom_h").drop("__meshloom_h")
    joined.repartition("__meshloom_shard").write.partitionBy("__meshloom_shard").parquet(uri)
    return found.select("shard", "depth", "shard_bytes").distinct()


ORACLE = f"""
WITH h AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 10))::BIGINT << {TEXT_BITS}) + ('0x' || substr(md5(coalesce(text, '')), 1, 5))::BIGINT AS h FROM documents),
n AS (SELECT d, h >> ({BITS} - d) AS p, sum(bytes) AS b, min(h) AS l, max(h) AS m FROM h, range(0, 40) r(d) GROUP BY ALL),
s AS (SELECT d, p FROM n WHERE b > {LIMIT_BYTES} AND l < m),
k AS (SELECT doc_id, bytes, h, (SELECT count(*) FROM s WHERE s.p = h.h >> ({BITS} - s.d))::INTEGER AS depth FROM h),
t AS (SELECT *, CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(h), {BITS}, '0'), 1, depth) END AS shard FROM k)
SELECT doc_id, bytes, shard, depth, (sum(bytes) OVER (PARTITION BY shard))::BIGINT AS shard_bytes FROM t
"""


def op7(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "bytes", "shard", "depth", "shard_bytes")
