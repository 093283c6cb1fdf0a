"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``.  A runner writes every stage's result and gives
the next stage what it reads back; ``run`` does so in the shared folder.

Stages take their rows as they are: null or empty texts are dropped by the quality
stage, rows with equal or without ids are judged one by one (of equal rows one stays),
extra columns ride along to the last stage, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pourline.llm.common import fresh_folder, table
from pourline.llm.decontamination import drop_leaks
from pourline.llm.guess_cost import vocabulary_words
from pourline.llm.near_dup import drop_near_duplicates
from pourline.llm.packing import pack
from pourline.llm.quality_model import drop_poor
from pourline.llm.queries import tokenizer
from pourline.llm.secret_scan import redact_secrets


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the weakly supervised classifier rejects."""
    return drop_poor(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five words, 0.8) one document, that with the smallest id; see drop_near_duplicates."""
    return drop_near_duplicates(docs, width=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and replaces the secrets in its text; n_chars follows."""
    return redact_secrets(docs, words=vocabulary_words(tokenizer("word_bpe_49k.json")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: where it stands in which sequence of 2048 tokens."""
    return pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]
#: SQL states neither the fitted classifier nor the tokenizer; tests/llm/test_pipeline.py compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = fresh_folder(spark, "corpus-pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            path = f"{folder}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
