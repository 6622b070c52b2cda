import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tamis import fixed
from tamis.config import DEFAULT, Config
from tamis.functions.decode import decode_ladder, decode_lossy
from tamis.functions.text import fold_accents, stem, suffix
from tamis.operators.blocks import parse_tickets
from tamis.operators.logs import find_hits
from tamis.sources import archives, generator, tickets


def made_zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_decode_ladder(spark):
    every = bytes(b for b in range(1, 256) if b not in b"\x81\x8d\x8f\x90\x9d")
    cases = {b"\xef\xbb\xbf\xef\xbb\xbfa": "﻿a", "é€".encode(): "é€", every: every.decode("cp1252"), b"\x81\x80": "\x81\x80", b"": ""}
    rows = spark.createDataFrame([(c,) for c in cases], "c binary").select("c", decode_ladder(F.col("c")).alias("t")).collect()
    assert {bytes(r["c"]): r["t"] for r in rows} == cases
    assert spark.createDataFrame([(b"a\xffb",)], "c binary").select(decode_lossy(F.col("c"))).first()[0] == "a�b"


def test_names(spark):
    row = spark.createDataFrame([("x/Req.1.MD", ".bashrc", "Ação ﬁm ½ Ⅷ ñ")], "a string, b string, c string").select(stem(F.col("a")), suffix(F.col("a")), suffix(F.col("b")), fold_accents(F.col("c"))).first()
    assert row[0] == "Req.1" and row[1] == ".md" and row[2] == "" and row[3].startswith("Acao fim 1⁄2")


def test_zip_guards():
    assert archives.members_of(made_zip([("b/c.log", "1"), ("a.txt", "2"), ("d/", ""), ("../e.log", "x"), ("/abs.log", "x")])) == [("a.txt", b"2"), ("b/c.log", b"1")]
    for config, members in ((Config(zip_max_members=1), [("a", "1"), ("b", "2")]), (Config(zip_max_bytes=3), [("a", "1234")]), (DEFAULT, [("a", "0" * 1_000_000)])):
        with pytest.raises(ValueError):
            archives.members_of(made_zip(members), config)
    with pytest.raises(ValueError):
        archives.members_of(b"not a zip")


def test_expand(spark):
    files = spark.createDataFrame([("t", 0, "x.ZIP", made_zip([("b.log", "1"), ("a.png", "2"), ("in.zip", "3")])), ("t", 1, "y.log", b"4"), ("u", 0, "bad.zip", b"?")], "ticket_id string, ord int, name string, content binary")
    rows = archives.expand(files).orderBy("ticket_id", "ord", "member").collect()
    assert [(r["ticket_id"], r["ord"], r["name"]) for r in rows] == [("t", 0, "a.png"), ("t", 0, "b.log"), ("t", 0, "in.zip"), ("t", 1, "y.log"), ("u", 0, None)]
    assert rows[-1]["error"]


def test_upload_names(spark):
    names = {"foto 1.PNG": "03_foto_1.PNG", "../../etc/x.log": "03_etc_x.log", "nota.docx": None, "": None}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", archives.upload_name(F.lit(3), F.col("n")).alias("u")).collect()
    assert {r["n"]: r["u"] for r in rows} == names


def test_ticket_files_and_pool(spark, tmp_path):
    (tmp_path / "req1.md").write_bytes("Ligação caiu".encode("cp1252"))
    (tmp_path / "req2.md").write_text("  ")
    (tmp_path / "req1_log.txt").write_text("packet loss")
    (tmp_path / "orphan_log.txt").write_text("x")
    found, logs = tickets.read_pool(spark, str(tmp_path))
    rows = {r["ticket_id"]: r for r in found.collect()}
    assert rows["req1"]["raw_text"] == "Ligação caiu" and rows["req1"]["error"] is None and rows["req2"]["error"]["slug"] == "chamado-nao-carregado"
    assert [(r["ticket_id"], r["name"]) for r in logs.collect()] == [("req1", "req1_log.txt")]


def test_payloads(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join(json.dumps(x) for x in ({"id": 7, "text": 12}, {"id": "", "text": "x"}, {"id": "8", "text": " ", "attachment_paths": ["a"]})))
    rows = tickets.read_payloads(spark, str(tmp_path / "p.json")).collect()
    assert [(r["ticket_id"], r["raw_text"], r["error"] is None) for r in rows] == [("7", "12", True), ("", "x", False), ("8", " ", True)]


def test_request_text(spark):
    df = spark.createDataFrame([("a", "b"), ("", "b"), (None, None), (" ", "b")], "x string, y string").select(tickets.request_text(F.col("x"), F.col("y")).alias("r"))
    assert [(r["r"]["text"], r["r"]["error"] is None) for r in df.collect()] == [("a", True), ("b", True), ("", False), (" ", False)]


def test_inline_and_generator(spark):
    row = tickets.from_texts(spark.createDataFrame([("oi",)], "text string")).first()
    assert len(row["ticket_id"]) == 8 and row["error"] is None
    assert generator.tickets(spark, 5).collect() == generator.tickets(spark, 5).collect()
    assert generator.log_lines(spark, 3, 10).where("line like '%CallerID%'").count() == 3


def test_made_tickets_have_all_blocks(spark):
    rows = [r["parsed"]["blocks"] for r in parse_tickets(generator.tickets(spark, 20).select("ticket_id", "raw_text")).collect()]
    assert all([b["name"] for b in r] == list(fixed.BLOCKS) for r in rows) and all(f["value"] for r in rows for b in r for f in b["fields"])
    counts = {r["ticket_id"]: r["n"] for r in generator.log_lines(spark, 20).groupBy("ticket_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(counts) == 20 and all(1500 <= n <= 2500 for n in counts.values()) and len(set(counts.values())) > 10
    assert find_hits(generator.log_lines(spark, 20)).groupBy("ticket_id").count().where("count = 1").count() == 20


def test_config_from_env():
    assert Config.from_env({"TAMIS_NLP_THRESHOLD": "0.5", "TAMIS_LOG_MAX_HITS": "x"}) == Config(nlp_threshold=0.5)


def test_attachments_of_a_folder(spark, tmp_path):
    (tmp_path / "a.log").write_text("x")
    paths = spark.createDataFrame([("t", 0, str(tmp_path / "a.log")), ("t", 1, str(tmp_path / "gone.log"))], "ticket_id string, ord int, path string")
    assert [(r["ord"], r["name"], bytes(r["content"])) for r in archives.read_attachments(paths, str(tmp_path)).collect()] == [(0, "a.log", b"x")]


def test_fetched_ticket_and_pick(spark):
    row = tickets.fetch(spark, lambda: {"id": 5, "text": "oi", "attachment_paths": ["a.log"]}).first()
    assert (row["ticket_id"], row["raw_text"], row["attachment_paths"], row["error"]) == ("5", "oi", ["a.log"], None)
    assert tickets.fetch(spark, lambda: {"id": None, "text": "x"}).first()["error"] is not None
    pool = generator.tickets(spark, 9)
    assert tickets.pick(pool, 1).collect() == tickets.pick(pool, 1).collect()
