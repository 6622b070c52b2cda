"""Log files as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions.decode import decode_lossy
from tamis.functions.text import LOG_LINE_BREAKS


def from_contents(files: DataFrame) -> DataFrame:
    """(ticket_id, att_ord, file_name, line_number, line) of (ticket_id, ord, name, content); lines count from 1."""
    text = F.regexp_replace(decode_lossy(F.col("content")), r"(?:\r\n|\r|\n)\z", "")
    lines = files.select("ticket_id", F.col("ord").alias("att_ord"), F.col("name").alias("file_name"), F.posexplode(F.when(F.octet_length("content") > 0, F.split(text, LOG_LINE_BREAKS, -1))).alias("i", "line"))
    return lines.select("ticket_id", "att_ord", "file_name", (F.col("i") + 1).cast("bigint").alias("line_number"), "line")


#: Blocks whose counts are broadcast; about 100 bytes each.
MOST_BLOCKS = 1_000_000


def read_large(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """(file_path, line_number, line) of files too large for one task; only lines where ``wanted`` holds, if given. Bytes that are no UTF-8 are replaced.

    A split file's blocks are counted first; a line's number is its place in its block plus the lines of the blocks
    before. A block is read by one task in order, so places need no sort. Only the counts are shuffled, and are
    broadcast, unless there are more than ``MOST_BLOCKS`` blocks, so lines stay where they are read.
    """
    lines = spark.read.text(path).select(F.make_valid_utf8("value").alias("line"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("file_path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    counts = counts.select("file_path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # at most one block a partition is whole, and one a file is not
    if len(lines.inputFiles()) + lines.rdd.getNumPartitions() <= MOST_BLOCKS:
        counts = F.broadcast(counts)
    kept = lines if wanted is None else lines.where(wanted)
    return kept.join(counts, ["file_path", "block"]).select("file_path", (F.col("at") - F.col("first") + 1 + F.col("before")).cast("bigint").alias("line_number"), "line")
