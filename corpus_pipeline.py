"""The corpus pipeline: documents to packed training sequences. Every stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm.common import heaps_returned, stored
from scoreloom.llm.exact_dedup import exact_dedup
from scoreloom.llm.language import identified
from scoreloom.llm.ngram_join import near_dedup
from scoreloom.llm.packing import pack
from scoreloom.llm.queries import remainder, word_vocabulary
from scoreloom.llm.toxicity import clean


#: Rows that Python is handed at once: whole texts, of which a usual batch of 10,000 takes much of an executor's memory.
BATCH_ROWS = 2048


def _narrow(spark: SparkSession) -> None:
    """Bounds the session's batches, and leaves it so: what a stage returns is computed after the stage has returned. Heap that the stage before has left is handed back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    heaps_returned(spark)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learnt from the labelled ones as in op7."""
    _narrow(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return clean(docs, labels.where(remainder("doc_id", 5) != 0))


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, however well the languages learnt as in op3 fit."""
    _narrow(spark)
    return identified(docs, docs.where(remainder("doc_id", 4) != 2))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id."""
    _narrow(spark)
    return exact_dedup(docs)


def distinct_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the one with the smallest id."""
    _narrow(spark)
    return near_dedup(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in full sequences."""
    _narrow(spark)
    return pack(docs, word_vocabulary())


STAGES = [("toxicity", not_toxic), ("language", with_language), ("exact_dedup", distinct_texts), ("ngram_join", distinct_shingles), ("packing", packed)]
#: Learnt scores and token ids can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage; see scoreloom.llm.packing.pack() for their columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
