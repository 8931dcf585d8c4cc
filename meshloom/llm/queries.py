"""Queries of the operators, each over its whole table with the parameters of production."""

from __future__ import annotations

from meshloom.llm import alignment, langid, lmscore, mixing, neardup, packing, periodic, quality, sharding, tokenbin, tokencount, topk, warc
from meshloom.llm.common import documents


def queries() -> dict:
    return {
        "op1_language_id": lambda spark, sf_dir: langid.op1(documents(spark, sf_dir)),
        "op2_mix_sources": lambda spark, sf_dir: mixing.op2(documents(spark, sf_dir)),
        "op3_token_counts": lambda spark, sf_dir: tokencount.op3(documents(spark, sf_dir)),
        "op4_token_binary": lambda spark, sf_dir: tokenbin.op4(spark, documents(spark, sf_dir)),
        "op5_best_fit_packing": lambda spark, sf_dir: packing.op5(documents(spark, sf_dir)),
        "op6_warc_index": lambda spark, sf_dir: warc.op6(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")),
        "op7_extendible_shards": lambda spark, sf_dir: sharding.op7(documents(spark, sf_dir)),
        "op8_quality_rules": lambda spark, sf_dir: quality.op8(documents(spark, sf_dir)),
        "op9_near_duplicates": lambda spark, sf_dir: neardup.op9(documents(spark, sf_dir)),
        "op10_exact_top_k": lambda spark, sf_dir: topk.op10(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
        "op11_lm_scores": lambda spark, sf_dir: lmscore.op11(documents(spark, sf_dir)),
        "op12_periodic_runs": lambda spark, sf_dir: periodic.op12(documents(spark, sf_dir)),
        "op13_token_alignment": lambda spark, sf_dir: alignment.op13(documents(spark, sf_dir)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": mixing.ORACLE,
        "op6_warc_index": warc.ORACLE,
        "op7_extendible_shards": sharding.ORACLE,
        "op8_quality_rules": quality.ORACLE,
        "op9_near_duplicates": neardup.ORACLE,
        "op10_exact_top_k": topk.ORACLE,
    }
