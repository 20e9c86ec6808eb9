"""Training-data pipeline over `documents`: STAGES in order, each written as Parquet and read again for the next.

Stages keep the columns of documents; the last one returns packed token pieces. ORACLE_SQL is None: SQL expresses neither
the fitted classifier nor sampling of shingles; the tests compare stages and the whole with brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.icws_dedup import keep_one
from termloom.llm.linear_packing import cut_tokens, pack
from termloom.llm.rule_quality import keep_quality
from termloom.llm.simhash_windows import decontaminate
from termloom.llm.suffix_dedup import remove_repeats
from termloom.session import cut_lineage

QUALITY_THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), QUALITY_THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes and more that also stand earlier; n_chars follows."""
    done = remove_repeats(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 2048 tokens."""
    return pack(cut_lineage(cut_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)))


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
