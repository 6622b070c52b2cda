"""What is known of each ticket's logs while their files keep arriving: counts, first hits, and lines so far.

Logs arrive as segments: text files in folders ticket_id=<id>/file_name=<name>, where names of later segments sort after
those of earlier ones, or packed, those of many tickets to a Parquet file. A micro-batch takes whole segments. It numbers their lines on from those of earlier batches and
writes what it adds, one row a ticket and one a file, to a folder of its own, named by the batch. State is the sum of
these folders, so a batch that is run again after a failure writes its folder over and changes nothing. Each ``COMPACT``
batches all folders up to the batch are merged into one; a folder that holds the sum up to a batch replaces those before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tamis.config import DEFAULT, Config
from tamis.operators import logs

SEGMENTS = "value string, ticket_id string, file_name string"
LENGTHS = "ticket_id string, file_name string, lines bigint"
HIT = "att_ord:string,line_number:bigint,file_name:string,symptom:string,label:string,text:string"
PARTS = f"ticket_id string, {', '.join(f'{s} bigint' for s in logs.SYMPTOMS)}, first array<struct<{HIT}>>"
#: Batches after which their folders are merged.
COMPACT = 20
FILE = ["ticket_id", "file_name"]


def read_segments(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """The lines of arriving segments, with the file and block they stand in."""
    lines = spark.readStream.schema(SEGMENTS).option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return lines.select("ticket_id", "file_name", F.make_valid_utf8("value").alias("line"), F.col("_metadata.file_name").alias("segment"), F.col("_metadata.file_block_start").alias("block"))


def write_packed(lines: DataFrame, folder: str) -> None:
    """Segments of many tickets to a Parquet file, a ticket's lines side by side and in order: as few files as tasks, however many tickets there are."""
    ordered = lines.repartition("ticket_id").sortWithinPartitions("ticket_id", "file_name", "line_number")
    ordered.select("ticket_id", "file_name", "line").write.mode("append").parquet(folder)


def read_packed(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same as ``read_segments``, of files that ``write_packed`` makes."""
    lines = spark.readStream.schema("ticket_id string, file_name string, line string").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return lines.select("ticket_id", "file_name", "line", F.col("_metadata.file_name").alias("segment"), F.col("_metadata.file_block_start").alias("block"))


def numbered(batch: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with att_ord and line_number, (ticket_id, file_name, lines) that the batch adds). lengths: lines of each file before it.

    As in ``log_lines.read_large`` a block is read by one task in order, and only counts of blocks are shuffled.
    """
    lines = batch.withColumn("at", F.monotonically_increasing_id())
    place = [*FILE, "segment", "block"]
    counts = lines.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(*FILE).orderBy("segment", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets = counts.join(lengths, FILE, "left").select(*place, "first", (F.col("before") + F.coalesce("lines", F.lit(0))).alias("before"))
    placed = lines.join(offsets, place).select("ticket_id", F.col("file_name").alias("att_ord"), "file_name", (F.col("at") - F.col("first") + 1 + F.col("before")).cast("bigint").alias("line_number"), "line")
    return placed, counts.groupBy(*FILE).agg(F.sum("n").alias("lines"))


class TicketState:
    """State below a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, config: Config = DEFAULT):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config

    def _folders(self, kind: str, before: int | None) -> list[str]:
        """Folders of a kind that make up the state before a batch: the last sum and what was added since."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = sorted((int(number), form) for s in fs.listStatus(root) for form, _, number in [s.getPath().getName().partition("-")] if form in ("add", "sum") and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        done = [(n, form) for n, form in done if before is None or n < before]
        base = max((n for n, form in done if form == "sum"), default=-1)
        return [f"{self.folder}/{kind}/{form}-{n}" for n, form in done if (form, n) == ("sum", base) or form == "add" and n > base]

    def _read(self, kind: str, schema: str, before: int | None) -> DataFrame:
        folders = self._folders(kind, before)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def lengths(self, before: int | None = None) -> DataFrame:
        return self._read("lengths", LENGTHS, before).groupBy(*FILE).agg(F.sum("lines").alias("lines"))

    def parts(self, before: int | None = None) -> DataFrame:
        return logs.merged(self._read("parts", PARTS, before), self.config)

    def add(self, batch: DataFrame, number: int) -> None:
        """Take in a micro-batch; again with the same number it writes the same."""
        lines, lengths = numbered(batch, self.lengths(number))
        logs.partials(logs.find_hits(lines), self.config).write.mode("overwrite").parquet(f"{self.folder}/parts/add-{number}")
        lengths.write.mode("overwrite").parquet(f"{self.folder}/lengths/add-{number}")
        if number % COMPACT == COMPACT - 1:
            self.parts(number + 1).write.mode("overwrite").parquet(f"{self.folder}/parts/sum-{number}")
            self.lengths(number + 1).write.mode("overwrite").parquet(f"{self.folder}/lengths/sum-{number}")

    def result(self) -> DataFrame:
        """What ``logs.summarize`` says of all lines so far; attachments count by name."""
        return logs.shown(self.parts(), self.config)

    def run(self, segments: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in what is there and stop; the checkpoint lets a later run go on from there."""
        return segments.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
