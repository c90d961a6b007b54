"""Queries of the training-data operators, by name, and the SQL of those that SQL can express.

Beside each operator's own query there are some that show those of its columns that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aquabill.llm import alignment, bpe, conversations, decontaminate, language_id, line_dedup, mixture, near_dedup, pipeline, quality, secrets, token_shards, url_filter, warc


def secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op1(spark, sf_dir).drop("spans")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = url_filter.op3(spark, sf_dir)
    return got.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7(spark, sf_dir).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secrets.op1,
        "op2_warc_revisits": warc.op2,
        "op3_url_filter": url_filter.op3,
        "op4_decontaminate": decontaminate.op4,
        "op5_language_id": language_id.op5,
        "op6_bpe": bpe.op6,
        "op7_quality_rules": quality.op7,
        "op8_near_dedup": near_dedup.op8,
        "op9_line_dedup": line_dedup.op9,
        "op10_token_shards": token_shards.op10,
        "op11_conversation_repair": conversations.op11,
        "op12_token_alignment": alignment.op12,
        "op13_mix_sources": mixture.op13,
        "pipeline": pipeline.run,
        "secret_patterns": secret_patterns,
        "url_rules": url_rules,
        "quality_base": quality_base,
        "conversation_faults": conversations.faults_of,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_revisits": warc.ORACLE, "op8_near_dedup": near_dedup.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op13_mix_sources": mixture.ORACLE,
        "secret_patterns": secrets.ORACLE, "url_rules": url_filter.ORACLE, "quality_base": quality.ORACLE,
        "conversation_faults": conversations.ORACLE,
    }
