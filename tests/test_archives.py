"""Archives that are damaged in any way, large members in bounded memory, attachments by path."""

import io
import random
import tracemalloc
import zipfile

import duckdb
import pyarrow as pa

from tamis.config import Config
from tamis.plans import workloads
from tamis.sources import archives
from tests.test_sources import made_zip

FILES = archives.FILES


def test_damaged_archives_are_rows_with_an_error(spark):
    """Bytes changed, cut off and put in anywhere never fail a job; what can still be read is right."""
    rng = random.Random(9)
    whole = made_zip([("b/app.log", "".join(f"line {rng.random()}\n" for _ in range(60))), ("a.png", bytes(rng.randrange(256) for _ in range(300))), ("c.log", "x" * 999)])
    want = archives.members_of(whole)
    rows = [("0", 0, "w.zip", whole), ("1", 0, "empty.zip", b""), ("2", 0, "null.zip", None)]
    for i in range(600):
        data = bytearray(whole)
        kind = i % 3
        if kind == 0:
            for _ in range(rng.randint(1, 4)):
                data[rng.randrange(len(data))] = rng.randrange(256)
        elif kind == 1:
            del data[rng.randrange(len(data)) :]
        else:
            at = rng.randrange(len(data))
            data[at:at] = bytes(rng.randrange(256) for _ in range(rng.randint(1, 9)))
        rows.append((str(i + 3), 0, "d.zip", bytes(data)))
    found = {}
    for r in archives.expand(spark.createDataFrame(rows, FILES)).collect():
        found.setdefault(r["ticket_id"], []).append(r)
    assert set(found) == {r[0] for r in rows} and [(r["name"], bytes(r["content"])) for r in found["0"]] == want
    bad = [k for k, v in found.items() if any(r["error"] for r in v)]
    assert len(bad) > 300 and all(len(found[k]) == 1 and found[k][0]["name"] is None for k in bad) and {"1", "2"} <= set(bad)
    lines = {r["ticket_id"] for r in archives.read_log_lines(spark.createDataFrame(rows, FILES)).select("ticket_id").distinct().collect()}
    assert not lines & set(bad) and "0" in lines


def test_names_of_members():
    names = {".": None, "..": None, "/abs.log": None, "../e.log": None, "a/../../e.log": None, "a/../b.log": "a/b.log", "./c.log": "c.log", "C:/x.log": None, "d\\e.log": "d/e.log", "a//b.log": "a/b.log"}
    assert {n: archives.safe_name(n) for n in names} == names
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in ((".", "x"), ("a.log", "first"), ("a.log", "last")):
            z.writestr(name, text)
    assert archives.members_of(data.getvalue()) == [("a.log", b"last")]


def test_lines_of_archives_and_plain_logs(spark):
    texts = {"one\r\ntwo\rthree\n\nfour": ["one", "two", "three", "", "four"], "": [], "\n": [""], "a\x0bb\x85c d": ["a\x0bb\x85c d"]}
    for text, want in texts.items():
        rows = [("t", 3, "in.zip", made_zip([("x/b.LOG", text), ("a.png", "packet loss\n"), (".log", "x\n")])), ("t", 1, "b.log", text.encode()), ("t", 2, "c.png", b"x")]
        got = archives.read_log_lines(spark.createDataFrame(rows, FILES)).orderBy("att_ord", "line_number").collect()
        assert [(r["att_ord"], r["file_name"], r["line_number"], r["line"]) for r in got] == [(o, n, i, x) for o, n in ((1000, "b.log"), (3002, "x/b.LOG")) for i, x in enumerate(want, 1)]
    bad = made_zip([("b.log", b"a\xffb\nc")])
    assert [r["line"] for r in archives.read_log_lines(spark.createDataFrame([("t", 0, "z.zip", bad)], FILES)).orderBy("line_number").collect()] == ["a�b", "c"]


def test_large_member_in_bounded_memory():
    """A member of 512 MiB is read line by line: the worker grows by pieces, not by the member."""
    line = b"INFO heartbeat " + b"x" * 1000 + b"\n"
    n = (512 << 20) // len(line)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z, z.open("big.log", "w", force_zip64=True) as f:
        for _ in range(n // 1000):
            f.write(line * 1000)
    batch = pa.RecordBatch.from_pydict({"ticket_id": ["t"], "ord": pa.array([0], pa.int32()), "content": pa.array([data.getvalue()], pa.binary())})
    del data
    tracemalloc.start()
    found = sum(b.num_rows for b in archives.line_batches([batch], Config(zip_max_ratio=10_000)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n // 1000 * 1000 and most < 32 << 20


def test_only_named_files_are_opened(spark, tmp_path):
    names = ["a.log", "b [1].log", "c{x}*.log", "d é.log", "not named.log"]
    for n in names:
        (tmp_path / n).write_text(n)
    rows = [("t", i, str(tmp_path / n)) for i, n in enumerate(names[:-1])] + [("u", 0, f"file://{tmp_path}/a.log"), ("u", 1, str(tmp_path / "gone.log")), ("u", 2, None)]
    out = archives.read_attachments(spark.createDataFrame(rows, "ticket_id string, ord int, path string"), str(tmp_path))
    got = sorted((r["ticket_id"], r["ord"], r["name"], bytes(r["content"]).decode()) for r in out.collect())
    assert got == sorted([("t", i, n, n) for i, n in enumerate(names[:-1])] + [("u", 0, "a.log", "a.log")])
    assert len([f for f in out.inputFiles() if f.endswith(".log")]) == 4 and not any("not%20named" in f or "not named" in f for f in out.inputFiles())
    nothing = archives.read_attachments(spark.createDataFrame([("t", 0, str(tmp_path / "gone.log"))], "ticket_id string, ord int, path string"), str(tmp_path))
    assert nothing.count() == 0


def test_many_names_are_opened_by_tasks(spark, tmp_path):
    """More names than may go through the driver give the same files as few do, of those that a listing has, as they are."""
    there = ["a.log", "b [1].log", "c{x}*.log", "d é%20.log", "x.log.gz", "in/e.log"]
    skipped = [".hidden.log", "_part.log", ".in/f.log", "in", "gone.log", "in/../a.log", "in//e.log", "in/", "../out/g.log"]
    root, rows = tmp_path / "root", []
    for n in ["in", ".in", "../out"]:
        (root / n).mkdir(parents=True, exist_ok=True)
    for n in [*there, ".hidden.log", "_part.log", ".in/f.log", "../out/g.log", "not named.log"]:
        (root / n).write_text(n)
    for i, n in enumerate([*there, *skipped]):
        rows += [("t", i, f"{root}/{n}"), ("u", i, f"file://{root}/{n}")]
    rows += [("t", 99, f"{tmp_path}/out/g.log"), ("t", 100, None), ("t", 101, str(root))]
    kinds, got = "ticket_id string, ord int, path string", lambda df: sorted((r["ticket_id"], r["ord"], r["name"], bytes(r["content"]).decode()) for r in df.collect())
    want = sorted((t, i, n.split("/")[-1], n) for t in "tu" for i, n in enumerate(there))
    few = archives.read_attachments(spark.createDataFrame(rows, kinds), str(root))
    assert got(few) == want and len(few.inputFiles()) == len(there)
    for i in range(1100):
        (root / f"many{i}.log").write_text(str(i))
    more = [("v", i, f"{root}/many{i}.log") for i in range(1100)]
    many = archives.read_attachments(spark.createDataFrame(rows + more, kinds), f"{root}/")
    assert got(many) == sorted(want + [("v", i, f"many{i}.log", str(i)) for i in range(1100)])
    assert not [f for f in many.inputFiles() if f.endswith(".log")]


def test_attached_files_of_repeated_and_odd_pages(spark, tmp_path, monkeypatch):
    """A number that comes again, with the same page or another, no number, a negative one, no html; with few names and with many."""
    pages = [(2, "a"), (2, "a"), (2, "b\nc\r"), (4, ""), (6, None), (None, "d"), (-8, "é"), (3, "odd"), (10**15, "x" * 3_000_000)]
    spark.createDataFrame(pages, "page_id bigint, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.sql(workloads.ORACLE_SQL["attached_files"]).fetchall())
    for few in (archives.FEW, 0):
        monkeypatch.setattr(archives, "FEW", few)
        assert sorted(tuple(r) for r in workloads.attached_files(spark, str(tmp_path)).collect()) == want
    assert len(want) == 6
