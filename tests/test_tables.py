from pyspark.sql import functions as F

from tamis.sources import tables

SF = "/root/testdata/sf0.001"


def test_a_small_file_is_dealt_out_and_a_large_one_read_as_it_is(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    read = lambda: tables.read_table(spark, SF, "documents").withColumn("task", F.spark_partition_id())
    rows, plain = read().collect(), spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in plain.select("doc_id").collect())
    assert len({r["task"] for r in rows}) == cores
    monkeypatch.setattr(tables, "SPREAD_BYTES", 10)
    assert len({r["task"] for r in read().collect()}) == 1
