"""Tables of test and ticket data, dealt out to all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of files that may be dealt out again: one split of Spark's default size.
SPREAD_BYTES = 128 << 20


def file_bytes(rows: DataFrame) -> int:
    """Bytes of the files that rows are read from."""
    jvm, conf = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in rows.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out to all cores, if they are few files of ``SPREAD_BYTES`` at most.

    A file of one row group is one task, however many cores wait, and the texts are worked on where they are read. The
    shuffle that deals them out moves no more than one split; larger tables have tasks enough and are read as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if len(rows.inputFiles()) >= cores or file_bytes(rows) > SPREAD_BYTES:
        return rows
    return rows.repartition(cores)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
