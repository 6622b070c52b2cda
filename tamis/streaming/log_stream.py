"""Running tallies over log files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tamis import scratch
from tamis.operators.logs import has_signature, match


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(file_path, line) of text files in a folder, new ones as they come."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("line"))


def tally(lines: DataFrame) -> DataFrame:
    """(symptom, label, hits) over all lines so far; the state is one row a signature."""
    hits = lines.where(has_signature(F.col("line"))).select(match(F.col("line")).alias("m"))
    return hits.groupBy("m.symptom", "m.label").agg(F.count(F.lit(1)).alias("hits"))


def checkpoint(spark: SparkSession, name: str) -> str:
    """A folder for a query's state below the shared one that the cluster names."""
    return f"{scratch.root(spark)}/{name}"


def run(lines: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Tally what is there and stop; the checkpoint lets a later run go on from there."""
    return tally(lines).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
