"""The corpus pipeline: five stages over the table documents, each written as Parquet and read again by the next one.

1. language_id drops documents whose language is undetermined or uncertain, or whose text is unlike that of any learned language.
2. line_dedup takes out lines that many documents share; n_chars follows the new text.
3. near_dedup keeps one document, the one of the smallest doc_id, of each group of near copies.
4. decontaminate drops documents that leak a benchmark item.
5. bpe gives each document's token ids and the text that they decode to.

Stages 1 to 4 return the columns of their input, whatever their names. Empty input gives empty output in every stage. Null
and empty texts, and texts without a letter, go in stage 1. Of rows with one doc_id that are kept by stage 1, stage 3 keeps all
or none; stage 4 drops all of them if one leaks. Rows without a doc_id are never near copies or leaks. Very long texts are read
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aquabill.llm import bpe, common, decontaminate, language_id, line_dedup, near_dedup

#: A posterior below this is no decision for a language.
MIN_SCORE = 0.5
#: A text whose letters are so many times as surprising as those of its language is in none that was learned (related ones can be less).
MAX_SURPRISE = 2.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language of posterior MIN_SCORE or more and a surprise of MAX_SURPRISE or less."""
    got = docs.select(F.struct(*docs.columns).alias("row"), language_id.identify(docs)("text").alias("found"))
    sure = (F.col("found.lang") != language_id.UNKNOWN) & (F.col("found.score") >= MIN_SCORE)
    return got.where(sure & (F.col("found.surprise") <= MAX_SURPRISE)).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeated lines."""
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return near_dedup.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded, n_tokens) of every document."""
    return bpe.encode(docs, bpe.load(), decoded=True).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontaminate", benchmark_stage), ("bpe", token_stage)]
#: Learned models, MinHash and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
