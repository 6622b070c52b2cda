"""The training-data pipeline: each stage works on all that the one before kept.

Language identification, exact deduplication, MinHash near-deduplication, benchmark decontamination, and mixing
of sources to target weights. Every stage but the last returns the columns of documents, extra ones too; stages
drop rows by an anti-join with the rows they reject, named by doc_id and a hash of the text, so a row of the same
doc_id with another text stays and a row with a null doc_id can go. Texts are shuffled only where many rows are
rejected. Null and empty texts go in the first stage, as they have no language; of repeated rows with one doc_id
and text either all stay or none; ties go as the operators say; empty tables give empty tables in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import curriculum, decontaminate, exact_dedup, language_id, minhash
from tamis.llm.common import row_key, stored, table, text_or_empty, without


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language with half the posterior, go."""
    return language_id.accept(docs, language_id.train_held_in(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays, a null one where there is no other."""
    rejected = exact_dedup.dedup(docs, keep="max").where("not kept").withColumnRenamed("digest", "row")
    return without(docs, rejected, exact_dedup.sha256(text_or_empty()), "exact-rejected")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the smallest doc_id stays; null ids, which link with nothing, stay."""
    return without(docs, minhash.cluster(docs).where("not kept"), row_key(), "near-rejected")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return without(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated"), row_key(), "benchmark-rejected")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document that is left, and the positions of its copies in training."""
    return curriculum.curriculum(docs).sort(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")


STAGES = [
    ("language_id", languages),
    ("exact_dedup", exact_copies),
    ("minhash_dedup", near_copies),
    ("decontaminate", benchmark_free),
    ("mix_sources", mix),
]

#: Naive Bayes, MinHash families and hash orders are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
