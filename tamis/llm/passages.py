"""Long repeated substrings over all documents, found from sampled buckets.

Both substring operators ask which windows of ``width`` units (bytes or words) start somewhere else too. The
units of a document get bucket identifiers for every power-of-two length, each from two identifiers of half
the length at this and a later offset (``arrays.Doubling``). Then:

1. *Initial buckets.* In every window the leftmost smallest identifier of ``gram`` units is its anchor, so equal
   windows have equal anchors at the same place. Consecutive windows with one anchor form a run, one row:
   (document, first, last window, anchor's bucket, bucket of the whole run). That is about one row for
   (width - gram) / 2 units.
2. *Refinement.* Runs whose anchor's bucket has one member are done: their windows are unique. Runs alike as a
   whole (same refined bucket) are settled at once. Only runs that share the anchor's bucket but not the whole,
   which is where copies begin, end or differ, are refined to single windows of ``width`` units, again by
   bucket identifiers.

Nothing is paired: all steps count buckets with partial aggregation and join the counts back by bucket, which
adaptive execution can split where a bucket is hot. A document's spans come together with its text once, at
the end.

Identifiers are names by content in place of names by rank: those need a sort of all suffixes in every round, one row
for each unit. A whole run or window is named by 96 bits, ``whole`` or ``bucket`` and 32 independent bits ``check``:
among 10^12 of them 6 * 10^-6 chance collisions are expected. An anchor's name of 64 bits only chooses what to compare.
Rows are named by (doc, row), see ``common.name_rows``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm import arrays
from tamis.llm.arrays import Doubling, lean, pieces
from tamis.llm.common import settle

RUNS = "doc bigint, row bigint, first int, last int, anchor bigint, whole bigint, check int"
ROW = ["doc", "row"]
#: bytes of a piece, offsets, seed -> (identifiers of its units, offsets of the rows in units)
Units = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def byte_units(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    return arrays.BYTE_CODES[seed][data], offsets


def word_units(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    starts, stops, cuts = arrays.words(data, offsets)
    return arrays.word_ids(data, starts, stops, seed), cuts


def runs_of(ids: Doubling, cuts: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first, last, anchor) of a piece's runs; positions count units of the piece, first and last are window starts."""
    sizes = np.diff(cuts)
    if not (sizes >= width).any():
        return (np.zeros(0, np.int64),) * 4
    keys = ids.all(gram)
    if len(keys) >> int(arrays.POSITION_BITS):
        raise ValueError("a text has more units than positions have bits")
    keys = keys >> arrays.POSITION_BITS << arrays.POSITION_BITS | np.arange(len(keys), dtype=np.uint64)
    anchors = arrays.sliding_min(keys, width - gram + 1) & np.uint64((1 << int(arrays.POSITION_BITS)) - 1)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(anchors)]
    at = np.flatnonzero(np.arange(len(anchors)) + width <= cuts[1:][row])
    own = anchors[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(new)
    first, last = at[heads], at[np.append(heads[1:], len(at)) - 1]
    return row[first], first, last, own[heads].astype(np.int64)


def whole_ids(ids: Doubling, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """Identifiers of whole runs: their first and last windows overlap, as a run has under ``width`` of them."""
    ends = arrays.pair(ids.at(first, width), ids.at(last, width), 1)
    return arrays.pair(ends, (last - first).astype(np.uint64), 2)


def _bigint(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _check(x: np.ndarray) -> pa.Array:
    return pa.array((x >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _names(batch: pa.RecordBatch, rows: slice, row: np.ndarray) -> dict[str, pa.Array]:
    at = pa.array(row + rows.start)
    return {c: batch.column(c).take(at) for c in ROW}


def find_runs(docs: DataFrame, units: Units, width: int, gram: int) -> DataFrame:
    """Runs of all windows of (doc, row, text); step 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                u, cuts = units(data, offsets, 0)
                ids = Doubling(u, width)
                row, first, last, anchor = runs_of(ids, cuts, width, gram)
                if len(row):
                    more = whole_ids(Doubling(units(data, offsets, 1)[0], width), first, last, width)
                    base = cuts[row]
                    yield pa.RecordBatch.from_pydict(_names(batch, rows, row) | {"first": pa.array((first - base).astype(np.int32)), "last": pa.array((last - base).astype(np.int32)), "anchor": _bigint(ids.at(anchor, gram)), "whole": _bigint(whole_ids(ids, first, last, width)), "check": _check(more)})

    settle(docs.sparkSession)
    return docs.select(*ROW, "text").mapInArrow(lean(run), RUNS)


def window_ids(docs: DataFrame, units: Units, width: int) -> DataFrame:
    """Bucket of every window of the asked runs of (doc, row, text, asked array<struct<first, last>>); step 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            for rows, data, offsets in pieces(batch):
                u, cuts = units(data, offsets, 0)
                own = asked[rows.start : rows.stop]
                spans, counts = own.flatten(), np.diff(own.offsets.to_numpy())
                first, last = (spans.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                n = last - first + 1
                row = np.repeat(np.repeat(np.arange(len(counts)), counts), n)
                at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                flat = at + cuts[row]
                more = Doubling(units(data, offsets, 1)[0], width).at(flat, width)
                yield pa.RecordBatch.from_pydict(_names(batch, rows, row) | {"at": pa.array(at.astype(np.int32)), "bucket": _bigint(Doubling(u, width).at(flat, width)), "check": _check(more)})

    settle(docs.sparkSession)
    return docs.select(*ROW, "text", "asked").mapInArrow(lean(run), "doc bigint, row bigint, at int, bucket bigint, check int")


def spans_by_doc(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc, row, spans): the settled runs and single windows of each row, at most as many as it has units."""
    spans = runs.select(*ROW, "first", "last").unionByName(windows.select(*ROW, F.col("at").alias("first"), F.col("at").alias("last")))
    return spans.groupBy(*ROW).agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def covered(n: int, width: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Mask of n units that windows starting in [first, last] cover."""
    edge = np.bincount(first, minlength=n + 1) - np.bincount(last + width, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def spans_of(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    value = batch.column("spans")[i].values
    if value is None or not len(value):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return value.field(0).to_numpy().astype(np.int64), value.field(1).to_numpy().astype(np.int64)
