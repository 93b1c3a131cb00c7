"""From raw documents to token ids: five stages, each written as Parquet and read again.

Toxic documents go, of each group of near copies one document stays, documents that hold
benchmark passages go, personal data is masked, and what is left is encoded. Every stage bounds
the session's Arrow batches, which hold whole texts (``bounded_batches``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowdeck.llm import op03_pii, op05_toxicity, op06_decontamination, op07_jaccard, op09_sentencepiece
from rowdeck.llm.common import bounded_batches, checkpoint_folder, table

ROW = "_row"  # the number of a row of a written table; the same in every scan of it


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half; columns as they came."""
    bounded_batches(spark)
    model = op05_toxicity.train(docs, table(spark, sf_dir, "labels"))
    return op05_toxicity.keep_clean(docs, model)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near copies one row, that of the smallest doc_id (NULL last). Rows are
    told apart by number, not by doc_id: unlike texts that share a doc_id, or have none, all stay."""
    bounded_batches(spark)
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id())
    groups = op07_jaccard.similar_sets(numbered.select(F.col(ROW).alias("doc_id"), "text"), n=5, percent=80)
    named = groups.select(F.col("doc_id").alias(ROW), "component_id").join(numbered.select(ROW, "doc_id"), ROW)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).getField(ROW)
    stay = named.groupBy("component_id").agg(first.alias(ROW)).select(ROW)
    return numbered.join(stay, ROW, "left_semi").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not cover half of any benchmark item; columns as they came."""
    bounded_batches(spark)
    return op06_decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    bounded_batches(spark)
    return op03_pii.masked(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_pieces, n_chars, exact)`` of every document."""
    bounded_batches(spark)
    return op09_sentencepiece.encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_per_group),
    ("benchmark decontamination", drop_leaks),
    ("PII", mask_personal_data),
    ("SentencePiece", encode),
]

# Learned models decide in three of the stages, which SQL cannot restate; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between them goes to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
