"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``, whatever they are.

Defined cases, for every stage: an empty table gives no rows; columns beside doc_id and text, also of names that a
stage uses itself, go through unchanged. What nulls, empty texts, ties and repeated rows do is said with each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm import decontam, dedup, jaccard, packing, quality
from foldline.llm.common import broadcast_if_small, id_remainder, spare, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Without labels to learn from none does.

    Null and empty texts have statistics of 0 and are scored like others; a null doc_id is scored, not learnt from;
    repeated rows get one score and go or stay together; a score of just 0.5 stays.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"), id_remainder("doc_id", 3) != 1)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, and of repeated rows of it one.

    Null and empty texts are equal, so one of them stays; a row with a null doc_id stays only if no equal text has an id.
    """
    return dedup.kept_rows(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays.

    Texts without words are linked with nothing and stay; rows with a null doc_id stay, and links run through them;
    rows of one doc_id are one document, so they stay or go together.
    """
    found, name = jaccard.similar(docs), spare(docs, "_gone_id")
    gone = written(found.filter("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(broadcast_if_small(gone, 16), F.col("doc_id") == F.col(name), "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts have no words and stay; rows that share a doc_id, or have none, are told apart by their texts.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence.

    A null or empty text is one piece that holds the end id; a null doc_id stays null; repeated rows are packed each.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
