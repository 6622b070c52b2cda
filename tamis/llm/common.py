"""Small helpers that the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set and all tasks run in this process."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


#: Scratch tables and broadcast values by session.
_made: WeakKeyDictionary[SparkSession, list[str]] = WeakKeyDictionary()
_shared: WeakKeyDictionary[SparkSession, list[Broadcast]] = WeakKeyDictionary()


def share(spark: SparkSession, value: object) -> Broadcast:
    """value, of a size that its operator bounds, on every executor until the session is swept."""
    _shared.setdefault(spark, []).append(spark.sparkContext.broadcast(value))
    return _shared[spark][-1]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark, []).append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Delete all scratch tables and broadcast values of this session; results that read them must have been written."""
    made, shared = _made.get(spark, []), _shared.get(spark, [])
    while shared:
        shared.pop().destroy()
    while made:
        delete(spark, made.pop())


#: What the operators ask of a session, set once and never back, so that queries side by side don't disturb each other:
#: an execution's shuffle files go when it ends, instead of when the driver collects its garbage, and Arrow batches are
#: bounded in bytes, as texts differ in length.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}


def settle(spark: SparkSession) -> None:
    for key, value in SETTINGS.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffles behind it are not needed again, so their files go as soon as the table is written.
    """
    spark = df.sparkSession
    settle(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``stored`` once nothing will read them again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, folder)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(name: str = "text") -> Column:
    """With doc_id, the name of a row: a hash of its text, so that rows of one doc_id with other texts, or of none, stay apart."""
    return F.xxhash64(F.col("doc_id").isNull(), text_or_empty(name))


#: Rows of short keys (at most an identifier and a digest of 32 bytes) that may be broadcast; about 32 MiB in memory.
BROADCAST_ROWS = 1 << 18


def small(keys: DataFrame) -> DataFrame:
    """A stored table of short keys, marked for broadcast if it has at most ``BROADCAST_ROWS`` rows; else Spark shuffles."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def without(docs: DataFrame, rejected: DataFrame, key: Column, name: str) -> DataFrame:
    """docs less the rows in rejected (doc_id, row): row is key's value there, so other rows of a doc_id stay, and null ids can go."""
    gone = small(stored(rejected.select(F.col("doc_id").alias("rejected_id"), F.col("row").alias("rejected_row")), name))
    return docs.join(gone, F.col("doc_id").cast("bigint").eqNullSafe(gone["rejected_id"]) & (key == gone["rejected_row"]), "left_anti")


def name_rows(docs: DataFrame, salted: bool) -> DataFrame:
    """(doc_id, doc, row, text): doc is doc_id without nulls; row tells rows of one doc where salted, else it is 0 and costs nothing."""
    id_ = F.col("doc_id").cast("bigint")
    return docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(0)).alias("doc"), (row_key() if salted else F.lit(0).cast("bigint")).alias("row"), text_or_empty().alias("text"))


def odd_names(docs: DataFrame) -> bool:
    """Whether a doc_id is null or repeated."""
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty()


FILTER_BITS = 24


def member_filter(keys: DataFrame) -> Callable[[Column], Column]:
    """A test whether a value may be one of keys (one column): no for most others, never for one of them.

    The filter has 2^FILTER_BITS bits (2 MiB) in words of 64, one array for all rows, however many keys there are.
    """
    place = lambda value: F.pmod(F.xxhash64(value), F.lit(1 << FILTER_BITS))
    words = keys.select(place(F.col(keys.columns[0])).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    every = keys.sparkSession.range(1 << FILTER_BITS - 6).select(F.col("id").alias("word")).join(words, "word", "left")
    listed = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    table_ = stored(every.agg(F.transform(listed, lambda w: w["bits"]).alias("words")), "member-filter").scalar()
    return lambda value: F.getbit(F.get(table_, F.shiftright(place(value), 6).cast("int")), (place(value) % 64).cast("int")) == 1
