"""A service desk as a Spark data source: pages of payloads, read as a batch or followed as a stream.

    register(spark)
    spark.read.format("tickets").option("client", "package.module:Client").option("at", "...").load()
    spark.readStream.format("tickets")...

The client is a class made with the option ``at``; it says how many pages there are and gives each page's payloads. Pages
are numbered, never change and only grow in number, so a page is all that a partition, or an offset of a stream,
has to name: a task that is run again reads the same, and a stream goes on at its first page not yet read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from importlib import import_module
from typing import Protocol

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tamis.sources.tickets import PAYLOAD

NAME = "tickets"
#: Pages that one task reads.
PAGES = 8


class Client(Protocol):
    def pages(self) -> int: ...

    def page(self, number: int) -> list[dict]: ...


class FolderClient:
    """Pages that lie in a folder as JSON lines, page-<number>.json; any file system that pyarrow knows."""

    def __init__(self, at: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(at if "://" in at or at.startswith("file:") else f"file://{at}")

    def pages(self) -> int:
        found = self.fs.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True))
        return sum(f.base_name.startswith("page-") and f.base_name.endswith(".json") for f in found)

    def page(self, number: int) -> list[dict]:
        with self.fs.open_input_stream(f"{self.folder}/page-{number}.json") as file:
            return [json.loads(line) for line in file.read().decode().splitlines()]


class PageRange(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


def _ranges(first: int, end: int) -> list[PageRange]:
    return [PageRange(i, min(i + PAGES, end)) for i in range(first, end, PAGES)]


class _Pages:
    def __init__(self, options: dict[str, str]):
        module, _, name = options.get("client", f"{__name__}:FolderClient").partition(":")
        self.make, self.at = (module, name), options.get("at", options.get("path", ""))

    def client(self) -> Client:
        return getattr(import_module(self.make[0]), self.make[1])(self.at)

    def rows(self, pages: PageRange | None) -> Iterator[tuple]:
        """Payloads as text, whatever their fields are; what is wrong with one is told by ``tickets.from_payloads``. Without pages Spark asks for None."""
        if pages is None:
            return
        client, text = self.client(), lambda x: None if x is None else x if isinstance(x, str) else json.dumps(x)
        for number in range(pages.first, pages.end):
            for payload in client.page(number):
                paths = payload.get("attachment_paths")
                yield text(payload.get("id")), text(payload.get("text")), None if paths is None else [str(p) for p in paths]


class PayloadReader(_Pages, DataSourceReader):
    def partitions(self) -> list[PageRange]:
        return _ranges(0, self.client().pages())

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return self.rows(partition)


class PayloadStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": self.client().pages()}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        return _ranges(start["page"], end["page"])

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return self.rows(partition)


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return PAYLOAD

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(dict(self.options))

    def streamReader(self, schema) -> PayloadStream:
        return PayloadStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PayloadSource)
