"""Command line and HTTP shells around the screening, on the standard library."""

from __future__ import annotations

import argparse
import json
import random
import sys
import threading
import uuid
from collections.abc import Iterator
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tamis import fixed
from tamis.config import Config
from tamis.functions.render import report, screening_json, taxonomy
from tamis.operators.classify import infer
from tamis.operators.screening import screen
from tamis.scratch import sweep
from tamis.sources import archives, tickets

PROBLEM = "application/problem+json"


def verdict(loaded: DataFrame, files: DataFrame | None, output: Column, config: Config) -> Row:
    """(status, exit_code, text) of one loaded ticket with its attachments (ticket_id, ord, name, content); text is the output wanted."""
    try:
        if files is None:
            out = screen(loaded, config=config)
        else:
            names = archives.expand(files, config, contents=False)
            if bad := names.where("error is not null").select("error").first():
                raise ValueError(bad["error"])
            placed = names.select("ticket_id", archives.place(F.col("ord"), F.col("member")).alias("ord"), "name")
            out = screen(loaded, placed, archives.read_log_lines(files, config), config)
        return out.select("status", "exit_code", output.alias("text")).first()
    finally:
        sweep(loaded.sparkSession)


def _problem(status: int, message: str, detail: str = "", **more: str) -> tuple[int, str, str]:
    return status, PROBLEM, json.dumps({"type": f"/erros/{fixed.SLUGS[message]}", "title": message.format(**more) if more else message, "status": status} | ({"detail": detail} if detail else {}), ensure_ascii=False)


def readable_limit(limit: int) -> str:
    return f"{limit // (1 << 20)} MB" if limit >= 1 << 20 else f"{limit // 1024} KB" if limit >= 1024 else f"{limit} bytes"


def form(body: bytes, content_type: str) -> tuple[dict[str, str], list[tuple[str, bytes]]]:
    """(fields, uploads (name, bytes) in order: anexos, then attachments) of a form's body."""
    if content_type.startswith("application/x-www-form-urlencoded"):
        return {k: v[0] for k, v in parse_qs(body.decode("utf-8", "replace"), keep_blank_values=True).items()}, []
    message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode("latin-1", "replace") + b"\r\n\r\n" + body)
    fields, uploads = {}, {"anexos": [], "attachments": []}
    for part in message.iter_parts() if message.is_multipart() else ():
        name, data = part.get_param("name", header="content-disposition"), part.get_payload(decode=True) or b""
        if part.get_filename() is None:
            fields.setdefault(name, data.decode("utf-8", "replace"))
        elif name in uploads:
            uploads[name].append((part.get_filename(), data))
    return fields, [*uploads["anexos"], *uploads["attachments"]]


def handle(spark: SparkSession, method: str, path: str, body: bytes, config: Config, content_type: str = "application/json") -> tuple[int, str, str]:
    """(status, content type, body) of a request."""
    ok = "application/json"
    if (method, path) == ("GET", "/healthz"):
        return 200, ok, json.dumps({"status": "ok"})
    if (method, path) == ("GET", "/readyz"):
        probe = infer(spark.createDataFrame([("probe", fixed.PROBE_TEXT)], "ticket_id string, masked string"), config=config).select("inference.symptom").first()
        ready = probe is not None and probe["symptom"] == fixed.AUDIO
        return (200 if ready else 503), ok, json.dumps({"status": "ok" if ready else "degradado", "ancoras": len(fixed.ANCHORS)})
    if (method, path) == ("GET", "/api/v1/symptoms"):
        return 200, ok, json.dumps(taxonomy(), ensure_ascii=False)
    if (method, path) != ("POST", "/api/v1/screenings"):
        return _problem(404, fixed.NO_RESOURCE)
    if len(body) > config.api_max_content_length:
        return _problem(413, fixed.TOO_LARGE, limit=readable_limit(config.api_max_content_length))
    uploads: list[tuple[str, bytes]] = []
    if content_type.split(";")[0].strip().endswith("json"):
        try:
            payload = json.loads(body or b"{}")
        except ValueError:
            payload = {}
    else:
        payload, uploads = form(body, content_type)
    if not isinstance(payload, dict):
        return _problem(500, fixed.INTERNAL_ERROR)
    text = payload.get("texto") or payload.get("text") or ""
    if not isinstance(text, str) or not text.strip():
        return _problem(400, fixed.TEXT_NEEDED, fixed.TEXT_NEEDED_DETAIL)
    ticket = uuid.uuid4().hex[:8]
    loaded = spark.createDataFrame([(ticket, text)], "ticket_id string, raw_text string")
    files = None
    if uploads:
        sent = spark.createDataFrame([(ticket, i, name, data) for i, (name, data) in enumerate(uploads) if name], "ticket_id string, ord int, name string, content binary")
        files = sent.withColumn("name", archives.upload_name(F.col("ord"), F.col("name"))).where("name is not null")
    try:
        row = verdict(loaded, files, screening_json(), config)
    except ValueError as e:
        return _problem(400, fixed.BAD_ATTACHMENT, str(e))
    return (422 if row["status"] == fixed.BLOCKED else 200), ok, row["text"]


def serve(spark: SparkSession, config: Config) -> ThreadingHTTPServer:
    turn = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            length = int(self.headers.get("Content-Length") or 0)
            body = self.rfile.read(min(length, config.api_max_content_length + 1))
            with turn:  # requests share one session
                status, kind, text = handle(spark, self.command, self.path, body, config, self.headers.get("Content-Type") or "")
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(text.encode())

        do_GET = do_POST = answer

    return ThreadingHTTPServer((config.api_host, config.api_port), Handler)


def read_interactive(lines: Iterator[str]) -> Iterator[str]:
    """Tickets typed in, each up to a line FIM; lines are kept as they come, tickets of blank lines are passed over, and one without FIM is dropped."""
    kept: list[str] = []
    for line in lines:
        if line.strip().upper() == "FIM":
            if (text := "\n".join(kept)).strip():
                yield text
            kept = []
        else:
            kept.append(line.removesuffix("\n"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tamis")
    source = parser.add_mutually_exclusive_group()
    source.add_argument("--text")
    source.add_argument("--text-file", "--file", dest="text_file")
    source.add_argument("--api-source", action="store_true", help="one ticket of the pool at random, with its log")
    parser.add_argument("--pool", default="data/raw", help="folder of the pool")
    parser.add_argument("--attachments", nargs="*", default=[])
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--interactive", action="store_true")
    parser.add_argument("--verbose", action="store_true")
    parser.add_argument("--quiet", action="store_true")
    parser.add_argument("--serve", action="store_true")
    args = parser.parse_args(argv)
    if not (args.text or args.text_file or args.api_source or args.interactive or args.serve):
        parser.error(fixed.SOURCE_NEEDED)
    config = Config.from_env()
    spark = spark or SparkSession.builder.appName("tamis").getOrCreate()
    if args.verbose or args.quiet:
        spark.sparkContext.setLogLevel("DEBUG" if args.verbose else "ERROR")
    if args.serve:
        serve(spark, config).serve_forever()
    output = screening_json() if args.json else report(config=config)

    def show(loaded: DataFrame, files: DataFrame | None) -> int:
        row = verdict(loaded, files, output, config)
        print(json.dumps(json.loads(row["text"]), ensure_ascii=False, indent=2) if args.json else row["text"])
        return row["exit_code"]

    if args.interactive:
        for text in read_interactive(sys.stdin):
            show(spark.createDataFrame([("interativo", text)], "ticket_id string, raw_text string"), None)
        return 0
    attached: DataFrame | None = None
    try:
        if args.text_file:
            loaded = tickets.read_text_files(spark, args.text_file)
        elif args.api_source:
            pool, attached = tickets.read_pool(spark, args.pool)
            loaded = tickets.pick(pool, random.randrange(1 << 31))
        else:
            loaded = tickets.from_texts(spark.createDataFrame([(args.text,)], "text string"))
        ticket = loaded.first()
    except AnalysisException:
        ticket = None
    if ticket is None or ticket["error"]:
        print(f"{ticket['error']['message']} {ticket['error']['detail']}".strip() if ticket else fixed.NO_TICKET, file=sys.stderr)
        return fixed.EXIT_ERROR
    name = ticket["ticket_id"]
    paths = args.attachments if attached is None else [r["path"] for r in attached.where(F.col("ticket_id") == name).select("path").collect()]
    try:
        files = archives.read_given(spark, name, paths) if paths else None
        return show(spark.createDataFrame([(name, ticket["raw_text"])], "ticket_id string, raw_text string"), files)
    except ValueError as e:
        print(f"{fixed.BAD_ATTACHMENT} {e}", file=sys.stderr)
        return fixed.EXIT_ERROR


if __name__ == "__main__":
    sys.exit(main())
