"""A corpus pipeline: language, quality, near duplicates, secrets, packing.

Each stage takes the documents that the one before kept and returns the columns of documents, but for the last, which
returns packed pieces. A stage's result is written as Parquet in the cluster's shared folder and read again.

Rows are judged one by one but for near duplicates, so a row that repeats gets its result each time. Null texts count as empty, null ids pass through,
other columns, whatever their names, are carried unread (n_chars is counted anew where a secret goes), and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import lang_id, ngram_join, packing, quality, secrets
from tickloom.llm.common import ensure_checkpoint_dir, table
from tickloom.llm.queries import BYTES


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no learned language: null or empty text, no letter, or a score under what its language's own texts of that length get. Equal scores go to the first language by name."""
    return lang_id.keep_languages(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules (null and empty texts do) or are mostly boilerplate."""
    return quality.retain(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each class; rows that repeat that id stay too, rows without an id always, and each empty text."""
    return ngram_join.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets; every row stays. Spans that overlap become one mark."""
    return secrets.redact(docs, secrets.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; an empty text is its end id alone."""
    return packing.pack(docs, BYTES)


STAGES = [("language_id", language), ("quality_rules", quality_rules), ("ngram_join", near_duplicates), ("secret_scan", secret_scan), ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
