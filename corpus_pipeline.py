"""Preparation of a corpus in five stages; each takes all rows that its predecessor kept.

Language ID rejects documents of no known language, quality rules reject junk, near-duplicate removal keeps one document of each
group (5-word shingles, Jaccard 0.8 or more), mixing repeats or leaves out documents until sources meet their weights, and
packing, the last, returns token sequences of at most 2048 ids instead of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import langid, mixing, neardup, packing, quality
from meshloom.llm.common import documents, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_rows(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Short documents are too few words to judge by, so only their repetitions count. Common words are counted over all documents."""
    return quality.judge_rows(docs, least_words=1, sample_docs=None)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): a document that the mix repeats is packed as often."""
    pieces = packing.encode_pieces(docs)
    return packing.pack(materialize(pieces, "pieces"))


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the scores of language ID, the order of the mix's copies or the packing. Stages are tested by operator: the rows of
#: quality rules and near duplicates against the verdicts of their queries, whose SQL compares all pairs, the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    out = STAGES[-1][1](spark, docs, sf_dir)
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
