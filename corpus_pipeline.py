"""A corpus pipeline of five stages; each takes what the one before kept.

Stage functions take (spark, docs, sf_dir) and return a DataFrame; all but the last return
the columns of ``docs``. ``run`` writes each stage's rows, reads them again for the next, and
removes what it no longer reads; the last stage's rows stay for the caller.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from furlong.llm import exact_dedup, near_dedup, secret_scan, toxicity
from furlong.llm.common import small_batches, table
from furlong.llm.queries import pack_documents
from furlong.scratch import checkpoint_dir, remove, temporary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic; the chain learns from labelled rows of ``docs``."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar sets of five-word shingles."""
    small_batches(spark)
    return near_dedup.drop_near_copies(docs, shingle=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with reported spans masked in their texts."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    small_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("secret scan", mask_secrets),
    ("packing", pack),
]

#: Near-duplicate components and packing are not for SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    top = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if k:
            remove(spark, f"{top}/{k - 1}")
    return docs
