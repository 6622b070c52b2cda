"""Ticket sources: files, inline texts, service-desk payloads, pools of tickets with sibling logs.

A bad row doesn't stop a batch: it carries an ``error`` struct (slug, http_status, message, detail), null where
all is well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis import fixed
from tamis.functions.decode import decode_ladder
from tamis.functions.text import stem, strip

PAYLOAD = "id string, text string, attachment_paths array<string>"


def error(message: str, detail: Column, http_status: int = 400) -> Column:
    return F.struct(F.lit(fixed.SLUGS[message]).alias("slug"), F.lit(http_status).alias("http_status"), F.lit(message).alias("message"), detail.alias("detail"))


def read_text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(ticket_id, raw_text, path, error): one ticket a file, named by the file's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    rows = files.select(stem(F.col("path")).alias("ticket_id"), decode_ladder(F.col("content")).alias("raw_text"), "path")
    empty = F.coalesce(strip(F.col("raw_text")), F.lit("")) == ""
    return rows.withColumn("error", F.when(empty, error(fixed.EMPTY_TICKET, F.col("path"))))


def from_texts(texts: DataFrame, *more: str) -> DataFrame:
    """(ticket_id, raw_text, error) of inline (text), and more columns of it; identifiers are random and differ from run to run."""
    rows = texts.select(*more, F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 8).alias("ticket_id"), F.col("text").alias("raw_text"))
    return rows.withColumn("error", F.when(F.coalesce(strip(F.col("raw_text")), F.lit("")) == "", error(fixed.EMPTY_TICKET, F.lit(""))))


def from_payloads(payloads: DataFrame, *more: str) -> DataFrame:
    """(ticket_id, raw_text, attachment_paths, error) of (id, text, attachment_paths), and more columns of it. A blank text is a text here."""
    rows = payloads.select(*more, F.col("id").cast("string").alias("ticket_id"), F.col("text").cast("string").alias("raw_text"), F.coalesce("attachment_paths", F.array().cast("array<string>")).alias("attachment_paths"))
    lacking = (F.coalesce("ticket_id", F.lit("")) == "") | (F.coalesce("raw_text", F.lit("")) == "")
    return rows.withColumn("error", F.when(lacking, error(fixed.INCOMPLETE_PAYLOAD, F.coalesce("ticket_id", F.lit("")))))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads from JSON lines; numbers become strings."""
    return from_payloads(spark.read.schema(PAYLOAD).option("primitivesAsString", "true").json(path))


def fetch(spark: SparkSession, fetcher: Callable[[], dict]) -> DataFrame:
    """The ticket that a service-desk client returns: a callable that gives {id, text, attachment_paths?}."""
    payload = fetcher()
    row = (str(payload.get("id") or ""), str(payload.get("text") or ""), [str(p) for p in payload.get("attachment_paths") or []])
    return from_payloads(spark.createDataFrame([row], PAYLOAD))


def pick(tickets: DataFrame, seed: int) -> DataFrame:
    """One ticket of a pool, at random."""
    return tickets.orderBy(F.rand(seed)).limit(1)


def read_pool(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tickets, attachments) of a folder of req*.md tickets and sibling <stem>_log.txt files."""
    tickets = read_text_files(spark, path, "req*.md")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_log.txt").load(path).select("path")
    logs = files.select(F.regexp_replace(stem(F.col("path")), "_log$", "").alias("ticket_id"), F.lit(0).alias("ord"), F.element_at(F.split("path", "/"), -1).alias("name"), "path")
    return tickets, tickets.select("ticket_id").join(logs, "ticket_id")


def request_text(texto: Column, text: Column) -> Column:
    """struct<text, error> of a request's two text fields: the first that is not empty, which must not be blank."""
    given = F.coalesce(F.nullif(texto, F.lit("")), F.nullif(text, F.lit("")), F.lit(""))
    bad = error(fixed.TEXT_NEEDED, F.lit(fixed.TEXT_NEEDED_DETAIL))
    return F.struct(given.alias("text"), F.when(strip(given) == "", bad).alias("error"))
