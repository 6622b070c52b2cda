import random
from collections import Counter

from pyspark.sql import functions as F

from tamis import fixed, scratch
from tamis.config import Config
from tamis.operators import logs
from tamis.sources.log_lines import from_contents, read_large
from tamis.streaming import log_stream

LINES = {
    "GET /api 500 Internal Server Error": "HTTP 5xx Server Error",
    "HTTP error: internal server error, code 503": "HTTP 5xx Server Error",
    "Uncaught TypeError: x": "JS Uncaught Exception",
    "FATAL: heap out of memory": "JS Heap Overflow",
    "High Jitter detected: 350ms": "Jitter Alto",
    "UDP PACKET LOSS": "Perda de Pacotes (UDP)",
    "SIP/408 timeout": "SIP Timeout/Erro",
    "ACD_QUEUE full: overflow": "Fila ACD Overflow",
    "AGENT_STATE 7 mismatch": "Divergência de Estado do Agente",
    "ROUTING_ENGINE: no available agent": "Sem Agente Disponível",
    "sip/480 packet loss": "SIP Timeout/Erro",
    "packet loss sip/480": "Perda de Pacotes (UDP)",
    "sip/500 ok": None,
    "code 5000 http": None,
    "": None,
}
SCHEMA = "ticket_id string, att_ord int, file_name string, line_number bigint, line string"


def test_signatures(spark):
    rows = spark.createDataFrame([("t", 0, "f", i, x) for i, x in enumerate(LINES)], SCHEMA)
    got = {r["line"]: r["label"] for r in logs.find_hits(rows).collect()}
    assert got == {k: v for k, v in LINES.items() if v}


def test_cap_counts_and_ties(spark):
    data = [("t", 1, "b", i, "packet loss tel (11) 98765-4321") for i in range(5)] + [("t", 0, "a", i, "heap out of memory") for i in range(5)] + [("u", 0, "a", 1, "ok")]
    lines = spark.createDataFrame(data, SCHEMA)
    files = spark.createDataFrame([("t", 2), ("u", 1)], "ticket_id string, scanned_files bigint")
    out = {r["ticket_id"]: r["log_analysis"] for r in logs.analyze(logs.find_hits(lines), files, Config(log_max_hits=6)).collect()}
    t = out["t"]
    assert t["total_hits"] == 10 and t["truncated"] and [h["file_name"] for h in t["hits"]] == ["a"] * 5 + ["b"]
    assert t["dominant_symptom"] == fixed.AUDIO and t["counts_by_symptom"] == {fixed.AUDIO: 5, fixed.UX: 5}
    assert t["hits"][5]["excerpt"] == "packet loss tel [TELEFONE_MASK]"
    u = out["u"]
    assert u["total_hits"] == 0 and u["dominant_symptom"] is None and u["hits"] == [] and not u["truncated"]
    floor = logs.analyze(logs.find_hits(lines), files, Config(log_dominance_min_hits=6)).where("ticket_id = 't'").first()
    assert floor["log_analysis"]["dominant_symptom"] is None


def test_hits_of_many_blocks_against_sorting(spark, monkeypatch):
    """The first hits and the counts are those of all lines in order, however lines fall into blocks and files."""
    rng = random.Random(3)
    data = [(f"t{rng.randrange(3)}", rng.randrange(3), f"f{rng.randrange(2)}", i, rng.choice([*LINES])) for i in range(3000)] + [("big", 0, "f", i, "UDP PACKET LOSS") for i in range(4000)] + [(None, 0, "f", 1, "UDP PACKET LOSS")]
    lines = spark.createDataFrame(data, SCHEMA).repartition(5)
    label = {k: v for k, v in LINES.items() if v}
    symptom = {v: s for s, v, _ in fixed.SIGNATURES}
    for size in (7, 100, 1 << 14):
        monkeypatch.setattr(logs, "BLOCK_LINES", size)
        got = {r["ticket_id"]: r for r in logs.summarize(logs.find_hits(lines), Config(log_max_hits=50)).collect()}
        assert set(got) == {"t0", "t1", "t2", "big", None}
        for t, r in got.items():
            own = sorted((x for x in data if x[0] == t and x[4] in label), key=lambda x: (x[1], x[3]))
            assert [(h["file_name"], h["line_number"], h["label"]) for h in r["hits"]] == [(x[2], x[3], label[x[4]]) for x in own[:50]]
            counts = Counter(symptom[label[x[4]]] for x in own)
            assert r["total_hits"] == len(own) and r["counts_by_symptom"] == counts and r["dominant_symptom"] == min(counts, key=lambda s: (-counts[s], s))


def test_one_pass_and_one_exchange(spark):
    """The tally reads its lines once and shuffles a row a ticket and task; the hits need one exchange more, by block."""
    spark.range(1000).selectExpr("cast(id % 5 as string) as ticket_id", "0 as att_ord", "'f' as file_name", "id as line_number", "'packet loss' as line").write.mode("overwrite").parquet(path := scratch.path(spark, "lines"))
    found = logs.find_hits(spark.read.parquet(path))
    for df, exchanges in ((logs.tally(found), 1), (logs.summarize(found), 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == exchanges and "partial_" in plan


def test_tri_state(spark):
    df = spark.createDataFrame([(fixed.UX, fixed.UX), (fixed.UX, fixed.AUDIO), (None, fixed.UX), (fixed.UX, fixed.UNKNOWN)], "d string, s string")
    assert [r[0] for r in df.select(logs.matches_text(F.col("d"), F.col("s"))).collect()] == [True, False, None, None]


def test_excerpt_is_cut_then_masked(spark):
    line = "x" * 233 + " 11987654321"
    assert spark.createDataFrame([(line,)], "l string").select(logs.excerpt(F.col("l"))).first()[0] == line[:240]


def test_lines_of_contents(spark):
    files = spark.createDataFrame([("t", 0, "a.log", b"one\r\ntwo\rthree\n\n\xff"), ("t", 1, "b.log", b"")], "ticket_id string, ord int, name string, content binary")
    got = [(r["line_number"], r["line"]) for r in from_contents(files).orderBy("line_number").collect()]
    assert got == [(1, "one"), (2, "two"), (3, "three"), (4, ""), (5, "�")]


def test_numbers_in_split_files(spark, tmp_path):
    text = [f"line {i} " + "y" * (i % 50) for i in range(3000)]
    (tmp_path / "big.log").write_bytes("\n".join(text).encode() + b"\nbad \xff\xc3( byte\n")
    text.append("bad \ufffd\ufffd( byte")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = read_large(spark, str(tmp_path)).orderBy("line_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["line"] for r in rows] == text and rows[-1]["line_number"] == 3001


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, n in enumerate((2, 3)):
        (folder / f"{i}.log").write_text("packet loss\nok\n" * n)
        log_stream.run(log_stream.read_lines(spark, str(folder)), "tally", str(tmp_path / "ck")).awaitTermination(60)
    assert [(r["label"], r["hits"]) for r in spark.table("tally").collect()] == [("Perda de Pacotes (UDP)", 5)]


def test_filter_mentions_a_made_line_once(spark):
    """A line that is made by an expression is made once, however many literals the filter looks for; odd letters count as before."""
    made = spark.createDataFrame([(1, "SIP/408"), (2, "ok"), (3, "PACKET LOSS"), (4, "Packet Loſs")], "id long, t string").selectExpr("'t' as ticket_id", "0 as att_ord", "'f' as file_name", "id as line_number", "concat(t, reverse('zyx')) as line")
    hits = logs.find_hits(made)
    assert sorted(r["line_number"] for r in hits.collect()) == [1, 3, 4]
    where = [x for x in hits._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert sum(x.count("concat(t") for x in where) <= 1
