"""Exact deduplication with a log-structured merge index of digests.

* ``flush``: every partition of a batch is a memtable; it is sorted by digest and written as one immutable
  sorted run (Parquet files with a Bloom filter on the digest, which lookups by digest can skip by).
* ``compact``: the runs are merged; one row for each digest keeps the identifier that stays and the count.
* The digests that occur more than once, the hits, are folded into a filter of fixed size
  (``common.member_filter``, 2 MiB, however many there are). Rows that it passes are all rows of hits and few others;
  only their texts are shuffled.
* ``verify``: these are held byte for byte: texts are grouped by (text, digest), which compares the texts
  themselves. Copies collapse before that shuffle, so a group with a third of all rows costs each task one row. A
  digest whose hits are of one text is settled by its index row; rows of a digest that two texts share are settled
  by their texts. Rows of earlier runs are verified as well: their documents are passed along with the runs.

Null text counts as empty; empty texts are equal to each other; repeated rows count each, and
those of the identifier that stays all stay; a null identifier
is kept as a row, and stays only where its group has no other. Extra columns are ignored. Empty tables give
no rows. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.common import member_filter, scratch_path, stored, table, text_or_empty

RUN_SCHEMA = "doc_id bigint, digest binary"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def flush(docs: DataFrame, path: str, digest=sha256) -> str:
    """Write one sorted run of (doc_id, digest) for each memtable of the batch; returns the run's path."""
    (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(text_or_empty()).alias("digest"))
        .sortWithinPartitions("digest", "doc_id")
        .write.option("parquet.bloom.filter.enabled#digest", "true")
        .option("parquet.bloom.filter.expected.ndv#digest", "200000")
        .parquet(path)
    )
    return path


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(*paths)


def compact(runs: DataFrame, keep: str = "min") -> DataFrame:
    """One row for each digest: the identifier that stays (smallest, or largest where asked) and the rows it stands for."""
    best = {"min": F.min, "max": F.max}[keep]
    return runs.groupBy("digest").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _rows(docs: DataFrame, digest) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn("digest", digest(F.col("text")))


def verify(docs: DataFrame, hits: DataFrame, keep: str = "min", digest=sha256) -> DataFrame:
    """(digest, group struct<keep_id, group_size, exact>): groups of byte-equal texts among the rows whose digest was hit.

    Texts are grouped before the hits are joined: a join by digest would first bring all copies of a text together.
    """
    best = {"min": F.min, "max": F.max}[keep]
    groups = _rows(docs, digest).where(member_filter(hits.select("digest"))(F.col("digest"))).groupBy("text", "digest").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    texts = F.struct("keep_id", "group_size", F.sha2(F.encode("text", "UTF-8"), 512).alias("exact"))
    return groups.select("digest", texts.alias("group")).join(hits.select("digest"), "digest", "left_semi")


def dedup(docs: DataFrame, keep: str = "min", runs: list[str] | None = None, digest=sha256, history: DataFrame | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row of ``docs``; ``runs`` adds those of earlier batches, ``history`` are their documents.

    Rows of earlier runs take part in keep_id and group_size but are not returned.
    """
    if runs and history is None:
        raise ValueError("hits of earlier runs are verified by their texts: pass the documents of the runs as history")
    spark = docs.sparkSession
    run = flush(docs, scratch_path(spark, "digest-run"), digest)
    # the compacted run is a table of its own, so that the join by digest is between two exchanges and can be split where a digest is hot
    index = stored(compact(read_runs(spark, [run, *(runs or [])]), keep), "digest-index")
    texts = docs.select("doc_id", "text") if history is None else docs.select("doc_id", "text").unionByName(history.select("doc_id", "text"))
    groups = stored(verify(texts, index.where("group_size > 1"), keep, digest), "digest-groups")
    # one distinct text for a digest, as good as always: the bytes are equal and the index row holds
    clash = stored(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "digest-clashes")
    own = read_runs(spark, [run])
    out = own.join(index, "digest").select("doc_id", "digest", "keep_id", "group_size")
    if not clash.isEmpty():
        # digests that several texts share: those rows alone are grouped by their texts
        rows = _rows(docs, digest).select("doc_id", "digest", F.sha2(F.encode("text", "UTF-8"), 512).alias("exact")).join(clash, "digest", "left_semi")
        rows = rows.join(groups.select("digest", "group.*"), ["digest", "exact"]).select("doc_id", "digest", "keep_id", "group_size")
        out = out.join(clash, "digest", "left_anti").unionByName(rows)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"), keep="max")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""
