"""Corpus pipeline: language, near-duplicates, benchmark leaks, personal data, packing.

Every stage takes what its predecessor kept, written as Parquet and read again, and all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import langid
from lexmill.llm.decontam import without_leaks
from lexmill.llm.packing import pack_documents
from lexmill.llm.pii import sanitise
from lexmill.llm.runtime import drop_staged, scratch_root, table
from lexmill.llm.simhash import keep_representatives

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Rows that travel to Python at once: several copies of a batch are held beside the heap.
BATCH = 1000


def frugal(spark: SparkSession) -> None:
    """For this session; Spark asks when a result is written, so this stays set: small batches, and
    shuffle files go when their query has ended, not when the driver happens to collect garbage."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labelled rows at hand; drop texts without a letter, without a language that leads,
    or mostly in scripts that no labelled row uses.  Null texts go."""
    frugal(spark)
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep the document with the smallest id."""
    frugal(spark)
    return keep_representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage; null and empty texts stay."""
    frugal(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data and the terms that disclose it; n_chars follows the text."""
    frugal(spark)
    return sanitise(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack what is left."""
    frugal(spark)
    return pack_documents(docs, size=1024)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: Tokenisation and trained models have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread.

    What a stage wrote for itself is deleted once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch_root(spark).rstrip('/')}/lexmill/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_staged(spark)
        docs = spark.read.parquet(path)
    return docs
