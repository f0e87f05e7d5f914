"""Documents to packed training sequences, stage by stage.

Each stage takes what the one before kept, as Parquet in the folder the cluster shares.
Toxic documents go; of each near-duplicate group one document stays; documents that hold a
benchmark item go; secrets in the others are replaced by a mark; what is left is packed into
sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redactstream.llm.decontamination import without_leaks
from redactstream.llm.near_dups import without_near_duplicates
from redactstream.llm.packing import best_fit_packing
from redactstream.llm.queries import prepare, table
from redactstream.llm.secrets import blank_secrets
from redactstream.llm.store import keep
from redactstream.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    # Similarity 0.8 or more; with 42 bands of 6 values such a pair is missed three times in a million.
    return without_near_duplicates(docs, percent=80, rows=6, bands=42)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return blank_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return best_fit_packing(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

# Trained scores and a tokenizer's ids are beyond SQL; tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
