"""A training-data pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidefold.llm import bpe, decontam, pii, simhash, toxicity
from tidefold.llm.common import staged, table
from tidefold.sources.ship import ensure_on_workers


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    ensure_on_workers(spark)
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity of 0.8 or more) stays."""
    ensure_on_workers(spark)
    return simhash.one_of_similar(docs, similarity=0.8, shingle=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    ensure_on_workers(spark)
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are masked in the texts; all documents stay."""
    ensure_on_workers(spark)
    return pii.sanitised(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and decoded bytes."""
    import public_tokenizers

    ensure_on_workers(spark)
    return bpe.tokens(docs, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("byte_level_bpe", bpe_stage),
]

#: SQL can express neither the trained classifier nor the fingerprints; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
