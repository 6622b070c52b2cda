"""Attachments: files by path, archives expanded and their logs read line by line, uploads renamed.

Archives need a Python worker. A task holds an archive's bytes and, of what is in it, one piece of ``PIECE`` bytes, one
line, or one member where whole members are asked for. Whatever is wrong with an archive is one row with an error.
"""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis import fixed
from tamis.config import DEFAULT, Config
from tamis.functions.text import suffix
from tamis.sources import log_lines

MEMBERS = "ticket_id string, ord int, member int, name string, size bigint, content binary, error string"
LINES = "ticket_id string, ord int, member int, name string, line_number bigint, line string"
PIECE = 1 << 20
#: Numbers that members of one archive may take; more than ``zip_max_members`` of any setting in use.
PER_ARCHIVE = 1000
#: Names of files that may go through the driver; more are looked up and opened by tasks.
FEW = 1000
#: Rows that name files, of one task.
PER_TASK = 2000
Members = list[tuple[str, zipfile.ZipInfo]]


def safe_name(name: str) -> str | None:
    """Where a member is put below its archive, or None for one that would leave it."""
    path = PurePosixPath(name.replace("\\", "/"))
    kept = [p for p in path.parts if p not in (".", "..")]
    if path.is_absolute() or not kept or ":" in kept[0] or posixpath.normpath(str(path)).split("/")[0] in ("..", "."):
        return None
    return "/".join(kept)


def _guarded(archive: zipfile.ZipFile, config: Config) -> Members:
    infos = archive.infolist()
    if len(infos) > config.zip_max_members:
        raise ValueError(f"archive has {len(infos)} members")
    size, packed = sum(i.file_size for i in infos), sum(i.compress_size for i in infos)
    if size > config.zip_max_bytes:
        raise ValueError(f"archive holds {size} bytes")
    if size / (packed or 1) > config.zip_max_ratio:
        raise ValueError(f"archive is compressed {size / (packed or 1):.0f} times")
    # of members of one name the last stays, as when files are written over
    named = {name: info for info in infos if not info.is_dir() and (name := safe_name(info.filename))}
    return sorted(named.items(), key=lambda x: x[0].split("/"))


def checked(content: bytes, config: Config = DEFAULT) -> tuple[zipfile.ZipFile, Members]:
    """An archive and its files by name, all read through once in pieces; raises ValueError where a guard fails or anything is damaged."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        members = _guarded(archive, config)
        for _, info in members:
            with archive.open(info) as file:
                while file.read(PIECE):
                    pass
        return archive, members
    except MemoryError:
        raise
    except Exception as e:  # a damaged archive can raise about anything: zlib.error, struct.error, IndexError, ...
        raise ValueError(f"archive can't be read: {e}") from e


def members_of(content: bytes, config: Config = DEFAULT) -> list[tuple[str, bytes]]:
    """(name, bytes) of an archive's files by name; raises ValueError where a guard fails or anything is damaged. Names that leave the archive are skipped."""
    archive, members = checked(content, config)
    return [(name, archive.read(info)) for name, info in members]


def _is_archive(name: Column) -> Column:
    return suffix(name).isin(*fixed.ARCHIVE_EXTENSIONS)


def expand(files: DataFrame, config: Config = DEFAULT, contents: bool = True) -> DataFrame:
    """(ticket_id, ord, name, content) with archives replaced by their files, numbered again; a bad archive is one row with an error.

    Without contents only names and sizes are told. Archives inside archives stay files. A null content is a bad archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("ticket_id", pa.string()), ("ord", pa.int32()), ("member", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for t, o, content in zip(*(batch.column(c) for c in ("ticket_id", "ord", "content")), strict=True):
                row = {"ticket_id": t.as_py(), "ord": o.as_py(), "member": 0, "name": None, "size": None, "content": None, "error": None}
                try:
                    archive, members = checked(content.as_py() or b"", config)
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([row | {"error": str(e)}], kinds)
                    continue
                for i, (name, info) in enumerate(members):
                    yield pa.RecordBatch.from_pylist([row | {"member": i, "name": name, "size": info.file_size, "content": archive.read(info) if contents else None}], kinds)

    base = files.select("ticket_id", F.col("ord").cast("int").alias("ord"), "name", "content")
    unpacked = base.where(_is_archive(F.col("name"))).select("ticket_id", "ord", "content").mapInArrow(run, MEMBERS)
    content = F.col("content") if contents else F.lit(None).cast("binary").alias("content")
    plain = base.where(~F.coalesce(_is_archive(F.col("name")), F.lit(False))).select("ticket_id", "ord", F.lit(0).alias("member"), "name", F.octet_length("content").cast("bigint").alias("size"), content, F.lit(None).cast("string").alias("error"))
    return plain.unionByName(unpacked)


def place(ord_: Column, member: Column) -> Column:
    """Number of a file among a ticket's files, those of archives in the place of their archive."""
    return ord_ * PER_ARCHIVE + member


_LINE = pa.schema([("ticket_id", pa.string()), ("ord", pa.int32()), ("member", pa.int32()), ("name", pa.string()), ("line_number", pa.int64()), ("line", pa.string())])


def _is_log(name: str) -> bool:
    return PurePosixPath(name.lower()).suffix in fixed.LOG_EXTENSIONS


def line_batches(batches: Iterator[pa.RecordBatch], config: Config = DEFAULT) -> Iterator[pa.RecordBatch]:
    """Numbered lines of the logs in archives (ticket_id, ord, content), about ``PIECE`` bytes at a time."""
    for batch in batches:
        for t, o, content in zip(*(batch.column(c) for c in ("ticket_id", "ord", "content")), strict=True):
            try:
                archive, members = checked(content.as_py() or b"", config)
            except ValueError:
                continue
            for member, (name, info) in enumerate(members):
                lines, size, first = [], 0, 1

                def part(lines: list[str], first: int) -> pa.RecordBatch:
                    n = len(lines)
                    columns = ([t.as_py()] * n, [o.as_py()] * n, [member] * n, [name] * n, range(first, first + n), lines)  # noqa: B023
                    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINE, strict=True)], schema=_LINE)

                if not _is_log(name):
                    continue
                with archive.open(info) as raw:
                    for line in io.TextIOWrapper(raw, "utf-8", "replace"):
                        lines.append(line.removesuffix("\n"))
                        size += len(line)
                        if size > PIECE:
                            yield part(lines, first)
                            lines, size, first = [], 0, first + len(lines)
                if lines:
                    yield part(lines, first)


def read_log_lines(files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(ticket_id, att_ord, file_name, line_number, line) of the logs among (ticket_id, ord, name, content), those in archives too.

    A member is decoded and cut as it is unpacked and never held whole; bad archives have no lines.
    """
    base = files.select("ticket_id", F.col("ord").cast("int").alias("ord"), "name", "content")
    packed = base.where(_is_archive(F.col("name"))).select("ticket_id", "ord", "content").mapInArrow(lambda batches: line_batches(batches, config), LINES)
    packed = packed.select("ticket_id", place(F.col("ord"), F.col("member")).alias("att_ord"), F.col("name").alias("file_name"), "line_number", "line")
    plain = base.where(suffix(F.col("name")).isin(*fixed.LOG_EXTENSIONS)).withColumn("ord", place(F.col("ord"), F.lit(0)))
    return log_lines.from_contents(plain).unionByName(packed)


FILES = "ticket_id string, ord int, name string, content binary"


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def _contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(at, content) of files that exist; characters that a path pattern would give a meaning have none."""
    if not paths:
        return spark.createDataFrame([], "at string, content binary")
    literal = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]
    return spark.read.format("binaryFile").load(literal).select(_plain(F.col("path")).alias("at"), "content")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the files below a folder; none is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")


#: Names below a folder that its listing doesn't have: hidden ones, and other ways to write a path.
_UNLISTED = r"(^|/)(\.|_(?!metadata|common_metadata|[^/]*=)|/|$)|\._COPYING_(/|$)"


def _located(spark: SparkSession, folder: str) -> tuple[str, str]:
    """A folder's whole address, and the same as ``_plain`` writes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    address = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    return address, re.sub("^file:/*", "/", address).rstrip("/")


def _file_system(root: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), root) if root[:1] in ("", "/") else pafs.FileSystem.from_uri(root)


def _for_tasks(root: str) -> bool:
    """Whether tasks can open files there: pyarrow knows that kind of address."""
    try:
        _file_system(root)
    except (ValueError, NotImplementedError, OSError):
        return False
    return True


def _opened(wanted: DataFrame, root: str, tasks: int) -> DataFrame:
    """(ticket_id, ord, path, content) of the files that exist, each read by the task that has its name; about ``PIECE`` bytes are held beside one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(root)
        for batch in batches:
            files = fs.get_file_info([base + at[len(root) :] for at in batch.column("at").to_pylist()])
            rows, contents, size = [], [], 0
            for i, file in enumerate(files):
                if file.type != pafs.FileType.File:
                    continue
                with fs.open_input_file(file.path) as f:
                    contents.append(f.read())
                rows.append(i)
                size += len(contents[-1])
                if size > PIECE:
                    yield _with_contents(batch, rows, contents)
                    rows, contents, size = [], [], 0
            if rows:
                yield _with_contents(batch, rows, contents)

    return wanted.repartition(tasks, "ticket_id", "ord", "at").mapInArrow(run, "ticket_id string, ord int, path string, content binary")


def _with_contents(batch: pa.RecordBatch, rows: list[int], contents: list[bytes]) -> pa.RecordBatch:
    named = batch.select(["ticket_id", "ord", "path"]).take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*named.columns, pa.array(contents, pa.binary())], ["ticket_id", "ord", "path", "content"])


def read_attachments(paths: DataFrame, folder: str) -> DataFrame:
    """(ticket_id, ord, name, content) of (ticket_id, ord, path) below a folder; paths that don't exist are skipped.

    Only files that a ticket names are looked up and opened, by the tasks that have their names, whatever else lies in the
    folder. Up to ``FEW`` names go through the driver to Spark's reader; so do all of them, joined with the folder's
    listing, where pyarrow doesn't know the kind of address. Contents never do.
    """
    spark = paths.sparkSession
    address, root = _located(spark, folder)
    wanted = paths.select("ticket_id", F.col("ord").cast("int").alias("ord"), "path", _plain(F.col("path")).alias("at"))
    below = F.substr("at", F.lit(len(root) + 2))
    wanted = wanted.where(F.startswith("at", F.lit(f"{root}/")) & ~F.regexp_like(below, F.lit(_UNLISTED)))
    names = wanted.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    n, rows = names.agg(F.count("at"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n > FEW and _for_tasks(root):
        read = _opened(wanted, root, max(spark.sparkContext.defaultParallelism, -(-rows // PER_TASK)))
    else:
        if n <= FEW:
            found = [p for r in names.toLocalIterator() if _is_file(spark, p := address + r["at"][len(root) :])]
        else:
            there = listing(spark, folder).select("path", _plain(F.col("path")).alias("at"))
            found = [r["path"] for r in there.join(names, "at", "left_semi").select("path").toLocalIterator()]
        read = wanted.join(_contents(spark, found), "at")
    return read.select("ticket_id", "ord", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isFile()


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """(ticket_id, path) of (ticket_id, name, content) written below a folder as they are named, each by the task that has it.

    A file is written beside its place and then moved there, so that a task that is run again, or twice, leaves whole files.
    """
    address, root = _located(files.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, base), made = _file_system(root), set()
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                path = f"{base}/{name}"
                if (within := posixpath.dirname(path)) not in made:
                    fs.create_dir(within)
                    made.add(within)
                part = f"{within}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as f:
                    f.write(content.as_buffer())
                fs.move(part, path)
            yield pa.RecordBatch.from_arrays([batch.column("ticket_id"), pa.array([f"{address}/{name}" for name in batch.column("name").to_pylist()], pa.string())], ["ticket_id", "path"])

    return files.select("ticket_id", "name", "content").mapInArrow(run, "ticket_id string, path string")


def read_given(spark: SparkSession, ticket_id: str, paths: list[str]) -> DataFrame:
    """The same for the paths a user names for one ticket."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [(i, p) for i, p in enumerate(paths) if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    out = spark.createDataFrame([], FILES)
    for i, p in there:
        file = spark.read.format("binaryFile").load(p)
        out = out.unionByName(file.select(F.lit(ticket_id).alias("ticket_id"), F.lit(i).alias("ord"), F.element_at(F.split("path", "/"), -1).alias("name"), "content"))
    return out


def upload_name(index: Column, name: Column) -> Column:
    """Name an upload is kept under, or null where its kind is not accepted."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("/"), F.lit(" ")), r"\s+", "_"), r"[^A-Za-z0-9_.-]", ""), r"^[._]+|[._]+$", "")
    safe = F.when(flat == "", F.concat(F.lit("anexo_"), index.cast("string"))).otherwise(flat)
    kinds = (*fixed.LOG_EXTENSIONS, *fixed.VISUAL_EXTENSIONS, *fixed.ARCHIVE_EXTENSIONS)
    return F.when(suffix(safe).isin(*kinds), F.concat(F.lpad(index.cast("string"), 2, "0"), F.lit("_"), safe))
