import duckdb
import pytest

from tamis.operators.entities import mask_sensitive_data
from tamis.plans import workloads
from tamis.plans.wrapping import NARRATIVES, duck, read

#: doc_id -> text; what counts stands below the first line.
DOCS = {
    1: "primeira linha\nsegunda com CPF 321.654.987-00\n\nquarta linha",
    5: "topo\nfalar com ana@b.org\nem 10.1.2.3 às 09:15\nfim",
    15: "\nso a segunda linha, mail c.d@e.net",
    16: "uma linha",
    22: None,
    31: "",
}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("narratives"))
    spark.createDataFrame(list(DOCS.items()), "doc_id bigint, text string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, 1)], "user_id bigint, event_id bigint").write.parquet(f"{out}/events.parquet")
    return out


def test_narratives_hold_whole_texts(spark, sf_dir):
    got = {r["doc_id"]: r["text"] for r in read(spark, sf_dir, NARRATIVES).collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet/*.parquet'")
    want = {d: t for _, d, t in con.sql(duck(NARRATIVES)).fetchall()}
    assert got == want and all((DOCS[d] or "") in t for d, t in got.items())


def test_lower_lines_are_screened(spark, sf_dir):
    texts = {r["ticket_id"]: r["text"] for r in read(spark, sf_dir, NARRATIVES).collect()}
    found = {(r["ticket_id"], texts[r["ticket_id"]][r["span_start"] : r["span_end"]]) for r in workloads.entity_spans(spark, sf_dir).collect()}
    assert {("1", "321.654.987-00"), ("5", "ana@b.org"), ("5", "10.1.2.3"), ("15", "c.d@e.net")} <= found
    masked = {r["ticket_id"]: r["masked"] for r in workloads.masked_text(spark, sf_dir).collect()}
    assert "\n\nquarta linha" in masked["1"] and not any(x in m for m in masked.values() for x in ("321.654", "ana@b", "c.d@e"))
    assert {r["ticket_id"] for r in workloads.text_evidence(spark, sf_dir).collect() if r["has_time"]} >= {"5"}


def test_lower_lines_reach_queries_without_twin(spark, sf_dir):
    """Lower lines continue the field that the narrative begins."""
    told = {d: " ".join(x for x in map(str.strip, (t or "").split("\n")) if x) for d, t in DOCS.items()}
    maps = {int(r["ticket_id"]): r for r in workloads.ticket_maps(spark, sf_dir).collect()}
    assert all(told[d] in r["blocks"] + (r["narrative"] or "") for d, r in maps.items())
    rows = spark.createDataFrame([(d, told[d]) for d in (1, 15)], "d bigint, t string").select("d", mask_sensitive_data("t").alias("m")).collect()
    bodies = {int(r["ticket_id"]): r["body"] for r in workloads.screening_documents(spark, sf_dir).collect()}
    reports = {int(r["ticket_id"]): r["report"] for r in workloads.screening_reports(spark, sf_dir).collect()}
    for r in rows:
        assert r["m"].split(" CPF")[0].split(" mail")[0] in bodies[r["d"]] and "321.654" not in bodies[r["d"]]
        assert "c.d@e" not in bodies[r["d"]] + reports[r["d"]]
    spark.catalog.clearCache()
