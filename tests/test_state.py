"""State that outlives a batch: the stream of ticket logs, remembered verdicts, the service desk as a source."""

import json
import random

from pyspark.sql import functions as F

from tamis import fixed, scratch
from tamis.config import Config
from tamis.operators import classify, logs, memo
from tamis.plans.workloads import _write_segments
from tamis.sources import payload_source, tickets
from tamis.streaming import log_stream, ticket_state
from tamis.streaming.ticket_state import TicketState, read_packed, read_segments, write_packed

LINES = ["packet loss tel (11) 98765-4321", "heap out of memory", "INFO ok", "ACD_QUEUE error", "", "  sip/404 é"]
SCHEMA = "ticket_id string, att_ord string, file_name string, line_number bigint, line string"


def told(df):
    return {r["ticket_id"]: (r["total_hits"], r["counts_by_symptom"], r["dominant_symptom"], [tuple(h) for h in r["hits"]]) for r in df.collect()}


def test_stream_agrees_with_one_pass_after_restarts(spark, monkeypatch):
    """Segments that arrive in three runs, files split into blocks, and folders merged on the way."""
    monkeypatch.setattr(ticket_state, "COMPACT", 3)
    rng, config = random.Random(4), Config(log_max_hits=7)
    rows = [(f"t{t}", f, f, i, rng.choice(LINES)) for t in range(4) for f in ("a.log", "b.log") for i in range(1, rng.randint(40, 80))]
    lines = spark.createDataFrame(rows, SCHEMA)
    folder, checkpoint = scratch.path(spark, "segments"), scratch.path(spark, "ck")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        for k in range(3):
            state = TicketState(spark, scratch.root(spark) + f"/state-{checkpoint[-8:]}", config)
            _write_segments(lines.where((F.col("line_number") > k * 20) & (F.col("line_number") <= (k * 20 + 20 if k < 2 else 999))), f"{folder}/run")
            # segment names sort by arrival
            state.run(read_segments(spark, f"{folder}/run", 5), checkpoint).awaitTermination()
        want = told(logs.summarize(logs.find_hits(lines), config))
        assert told(state.result()) == want and {k[0] for k in want} == {"t"}
        assert {(r["ticket_id"], r["file_name"]): r["lines"] for r in state.lengths().collect()} == {(t, f): max(x[3] for x in rows if x[0] == t and x[2] == f) for t, f in {(x[0], x[2]) for x in rows}}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_packed_segments_agree_with_one_pass(spark):
    """Many tickets in few files: batches follow the files, not the tickets."""
    rng, config, folder, checkpoint = random.Random(5), Config(log_max_hits=7), scratch.path(spark, "packed"), scratch.path(spark, "ck")
    lines = spark.createDataFrame([(f"t{t}", "a.log", "a.log", i, rng.choice(LINES)) for t in range(300) for i in range(1, rng.randint(2, 40))], SCHEMA)
    state = TicketState(spark, scratch.path(spark, "state"), config)
    for part in ("line_number <= 20", "line_number > 20"):
        write_packed(lines.where(part), folder)
        stream = state.run(read_packed(spark, folder), checkpoint)
        stream.awaitTermination()
        assert len([p for p in stream.recentProgress if p["numInputRows"]]) == 1
    assert told(state.result()) == told(logs.summarize(logs.find_hits(lines), config))


def test_a_batch_again_changes_nothing(spark):
    state = TicketState(spark, scratch.path(spark, "state"), Config(log_max_hits=3))
    batches = [spark.createDataFrame([("t", "a.log", "packet loss", f"s{n}", 0)] * 2, "ticket_id string, file_name string, line string, segment string, block bigint").coalesce(1) for n in range(3)]
    assert state.result().count() == 0
    for order in ((0, 1), (1,), (2, 2)):
        for n in order:
            state.add(batches[n], n)
    assert told(state.result()) == {"t": (6, {fixed.AUDIO: 6}, fixed.AUDIO, [("a.log", i, fixed.AUDIO, "Perda de Pacotes (UDP)", "packet loss") for i in (1, 2, 3)])}


def test_checkpoints_lie_in_the_shared_folder(spark):
    assert log_stream.checkpoint(spark, "x") == f"{scratch.root(spark)}/x"


def test_verdicts_are_remembered(spark):
    """Texts with a verdict are not classified again: a wrong one in the table shows. Another model has its own."""
    table = scratch.path(spark, "memo")
    texts = [t for _, t in fixed.ANCHORS] + ["", None, "xxxxx", "abc"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "n bigint, masked string")
    want = {(r["n"]): r["inference"] for r in classify.infer(rows, "n").collect()}
    assert {r["n"]: r["inference"] for r in memo.infer_remembered(rows.where("n < 20"), table).collect()} == {n: v for n, v in want.items() if n < 20}
    stored = spark.read.parquet(table)
    assert stored.count() == 20
    assert {r["n"]: r["inference"] for r in memo.infer_remembered(rows, table).collect()} == want
    assert spark.read.parquet(table).count() == len(set(texts)) - 1  # null has no digest
    wrong = stored.where(F.col("digest") == F.sha2(F.lit("novo texto aqui"), 256)).unionByName(stored.limit(1).withColumn("digest", F.sha2(F.lit("novo texto aqui"), 256)))
    wrong.drop("model").withColumn("inference", F.expr("named_struct('symptom', 'ERRADO', 'confidence', 1.0D, 'runner_ups', inference.runner_ups)")).write.mode("append").parquet(f"{table}/model={memo.model_version()}")
    new = spark.createDataFrame([(1, "novo texto aqui")], "n bigint, masked string")
    assert memo.infer_remembered(new, table).first()["inference"]["symptom"] == "ERRADO"
    assert memo.infer_remembered(new, table, config=Config(nlp_threshold=0.2)).first()["inference"]["symptom"] == fixed.UNKNOWN


def test_service_desk_as_a_source(spark, tmp_path):
    payload_source.register(spark)
    page = lambda n, rows: (tmp_path / f"page-{n}.json").write_text("\n".join(map(json.dumps, rows)))
    for n in range(11):
        page(n, [{"id": 10 * n, "text": f"texto {n}", "attachment_paths": ["a.log", 7]}, {"id": f"x{n}"}, {"text": 5}])
    loaded = tickets.from_payloads(spark.read.format("tickets").option("at", str(tmp_path)).load())
    rows = loaded.collect()
    assert len(rows) == 33 and loaded.rdd.getNumPartitions() == 2
    assert sorted(r["ticket_id"] for r in rows if r["error"] is None) == sorted(str(10 * n) for n in range(11)) and rows[0]["attachment_paths"] == ["a.log", "7"]
    assert {r["raw_text"] for r in rows if r["ticket_id"] is None} == {"5"}

    def follow():
        stream = spark.readStream.format("tickets").option("at", str(tmp_path)).load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(once=True).start()
        stream.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").count()

    assert follow() == 33
    page(11, [{"id": 1, "text": "novo"}])
    assert follow() == 34  # goes on at the first page not yet read
    assert spark.read.format("tickets").option("at", f"{tmp_path}/nothing").load().count() == 0
