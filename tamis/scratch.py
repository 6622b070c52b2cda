"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set and all tasks run in this process."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


#: Tables made and not yet deleted, by session.
_made: WeakKeyDictionary[SparkSession, list[str]] = WeakKeyDictionary()


def path(spark: SparkSession, name: str) -> str:
    made = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark, []).append(made)
    return made


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows written and read back: worked out once however often they are read, and still there when executors are lost."""
    at = path(rows.sparkSession, name)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


#: An execution's shuffle files go when it ends, and Arrow batches are bounded in bytes, as texts differ in length.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}


def settle(spark: SparkSession) -> None:
    """Set what an operator of large tables asks of a session, once and never back."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)


def exists(spark: SparkSession, where: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def sweep(spark: SparkSession) -> None:
    """Delete this session's tables; what reads them must have been used."""
    made = _made.get(spark, [])
    while made:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
