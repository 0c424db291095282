"""The corpus pipeline: documents through five operators, each stage written and read again.

Language ID drops documents of no language (no letter, or too few known
n-grams), the n-gram Jaccard join keeps one document of each component, decontamination
drops documents that hold a benchmark window, the mix repeats or leaves out
documents so that the sources reach their weights, and the token store is
written and read back. Stages keep extra columns; each runs over all rows that
its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airlens.llm import binary, decontaminate, jaccard, langid, mixing
from airlens.llm.common import scratch, ship

# near copies: 5-word shingles, a similarity of 0.8 or more (op4 by itself has its own contract)
NEAR_WORDS = 5
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that are in one of the languages."""
    ship(spark)
    return langid.identified(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each component of linked documents."""
    ship(spark)
    return jaccard.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents without a benchmark window."""
    ship(spark)
    bench = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.clean_documents(docs, bench)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: every document as often as the mix takes it."""
    return mixing.documents_taken(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the token store of what is left, read back."""
    ship(spark)
    return binary.query(docs)


STAGES = [("language ID", language_id),
          ("n-gram Jaccard join", one_of_near_copies),
          ("benchmark decontamination", drop_contaminated),
          ("mixing sources to target weights", mix_sources),
          ("token-ID / binary output", write_tokens)]

# a trained model, hashed draws and a tokenizer have no SQL form; tests hold the stages to brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the others' results are tables in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
