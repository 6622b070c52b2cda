"""Classification with a memory: verdicts of texts kept in a table, so that later batches classify only texts not seen before."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis import fixed, scratch
from tamis.config import DEFAULT, Config
from tamis.operators.classify import decide, infer, ranked

INFERENCE = "struct<symptom:string,confidence:double,runner_ups:array<struct<symptom:string,score:double>>>"
VERDICTS = f"digest string, inference {INFERENCE}"


def model_version(config: Config = DEFAULT) -> str:
    """A name for all that a verdict depends on beside the text: anchors and settings."""
    settings = (config.nlp_threshold, config.nlp_min_text_length, config.nlp_ngram_min, config.nlp_ngram_max)
    return hashlib.sha256(repr((fixed.ANCHORS, settings)).encode()).hexdigest()[:16]


def infer_remembered(texts: DataFrame, table: str, text: str = "masked", config: Config = DEFAULT) -> DataFrame:
    """texts with ``inference``, from a table of verdicts that grows by what is new.

    The table is Parquet below a shared folder, a folder for each model, its files in the order of the texts' digests. Only
    digests are shuffled to look texts up, and each different new text is classified once. A batch that is run
    again, or beside another, can at most write a verdict twice, and equal ones; they are grouped when read.
    """
    spark = texts.sparkSession
    folder = f"{table.rstrip('/')}/model={model_version(config)}"
    named = texts.withColumn("_digest", F.sha2(text, 256))
    there = scratch.exists(spark, folder)
    known = spark.read.schema(VERDICTS).parquet(folder) if there else spark.createDataFrame([], VERDICTS)
    known = known.groupBy("digest").agg(F.any_value("inference").alias("inference"))
    seen = named.where("_digest is not null").groupBy("_digest").agg(F.count(F.lit(1)).alias("n"))
    looked = scratch.stored(seen.join(known, F.col("_digest") == F.col("digest"), "left").select("_digest", "inference"), "looked")
    new = named.join(looked.where("inference is null").select("_digest"), "_digest", "left_semi").select("_digest", text).distinct()
    fresh = infer(new, "_digest", text, config).select("_digest", F.col("inference").cast(INFERENCE).alias("inference"))
    fresh = scratch.stored(fresh, "verdicts")
    fresh.select(F.col("_digest").alias("digest"), "inference").sortWithinPartitions("digest").write.mode("append").parquet(folder)
    verdicts = looked.where("inference is not null").unionByName(fresh)
    none = decide(F.lit(None).cast("string"), ranked(F.lit(None).cast("array<double>")), config)
    return named.join(verdicts, "_digest", "left").withColumn("inference", F.coalesce("inference", none)).drop("_digest")
