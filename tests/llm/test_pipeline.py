import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tamis.llm import language_id, minhash, registry
from tests.llm.test_dedup import exact_expected, minhash_expected
from tests.llm.test_text import leaks

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    pred = {r["doc_id"]: r for r in language_id.query(spark, SF).collect()}
    assert all(pred[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in rows)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        left = {r["doc_id"] for r in kept.collect()}
        if name == "language_id":
            want = {d for d in before if pred[d]["lang_pred"] != language_id.UNKNOWN and pred[d]["score"] >= 0.5}
        elif name == "exact_dedup":
            want = {d for d, x in exact_expected(before.items(), max).items() if x[2]}
        elif name == "minhash_dedup":
            want = {d for d, x in minhash_expected(list(before.items())).items() if x[2]}
        else:
            short = {d: t for d, t in before.items() if len(t) < 3000}
            want = {d for d, hit in leaks(short.items(), items).items() if not hit}
            left &= set(short)
        assert left == want, name
    mixed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert mixed.count() == kept.count()
    assert minhash.WORDS == 5 and minhash.PERCENT == 75


@pytest.mark.parametrize("name", sorted(n for n, sql in registry.oracle_sql().items() if n != "pipeline"))
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_stages_with_odd_rows(spark):
    """Rows of one doc_id with different texts go or stay by themselves; null ids can go; extra columns come along."""
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r["text"].split()) > 15)
    stages = dict(corpus_pipeline.STAGES)
    a, b = "the first text of all", "the other text"
    rows = [(1, a), (1, b), (5, a), (None, a), (None, "alone"), (2, None), (3, ""), (3, "")]
    docs = lambda rows: spark.createDataFrame([(d, t, "x", d) for d, t in rows], "doc_id bigint, text string, row string, rejected_id bigint")
    left = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    out = stages["exact_dedup"](spark, docs(rows), SF)
    assert out.columns == ["doc_id", "text", "row", "rejected_id"]
    assert left(out) == sorted([(1, b), (5, a), (None, "alone"), (3, ""), (3, "")], key=str)
    long = " ".join(f"w{i}" for i in range(60))
    near = [(4, long), (4, "something else"), (7, long + " more"), (None, long), (8, None), (4, long)]
    assert left(stages["minhash_dedup"](spark, docs(near), SF)) == sorted([(4, long), (4, long), (4, "something else"), (None, long), (8, None)], key=str)
    leak = [(1, f"see {item} end"), (1, "clean"), (None, item), (None, "clean too"), (2, "")]
    assert left(stages["decontaminate"](spark, docs(leak), SF)) == sorted([(1, "clean"), (None, "clean too"), (2, "")], key=str)
    assert stages["mix_sources"](spark, docs(near).withColumn("source", F.col("row")), SF).count() == 6


def test_stages_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
