"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over at most ``SPAN`` consecutive tokens that hashes the tokens at its ones and ignores the
others, so it matches through substitutions at the ignored places. Seeds of documents and of benchmark items
are joined; around every hit the document's tokens are laid along the item's on the same diagonal, and the
document is contaminated if some ``LEAST`` consecutive tokens there (all of an item that has fewer) agree in at
least ``SHARE`` of the places.

Seeds of the benchmark are folded into a bit table of fixed size (``FILTER_BITS`` bits, 2 MiB, whatever the
benchmark's size), which is broadcast to drop almost all document seeds while texts are read; those left are
joined to the benchmark's seeds by key. Neighbouring hits of a document share one row of context tokens, of at most
``REGION_TOKENS`` and the context on both sides, as it is read once for each diagonal: a long document that holds many
items would else be repeated whole for each of them. Windows that agree hold a seed of their own, so no result
depends on where rows are cut.

Tokens are runs of letters, digits and non-ASCII bytes; A-Z count as a-z. Null and empty texts and items match
nothing. An item of fewer than ``SPAN`` tokens has one seed of all its tokens, and must agree in all. Repeated
items and rows give equal results; rows with a null item_id are left out of the benchmark; rows are told apart by
doc_id and a hash of the text, so a null or repeated doc_id is no matter. Extra columns are ignored; empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import arrays
from tamis.llm.arrays import lean, pieces
from tamis.llm.common import row_key, settle, share, stored, table, text_or_empty

#: Ones are the token positions that a seed looks at. Every placing of two substitutions in ``LEAST`` or ``SPAN``
#: tokens, the most that verification accepts, leaves some mask whole; found by enumeration, and a test enumerates them.
MASKS = ("11110111", "1110100111", "10100111101", "11011101001")
SPAN = 12
LEAST = 13
SHARE = 0.8
CONTEXT = 24
REGION_TOKENS = 256
FILTER_BITS = 24

NOT_TOKEN = np.ones(256, dtype=bool)
NOT_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = arrays.LOWER[data]
    starts, stops, cuts = arrays.words(data, offsets, NOT_TOKEN)
    return arrays.word_ids(data, starts, stops), cuts


def seed_keys(ids: np.ndarray, mask: str) -> np.ndarray:
    """Key of the mask's tokens at every position; other masks give other keys."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, hash_mask(mask), dtype=np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = arrays.pair(out, ids[i : i + n], 7)
    return out


def hash_mask(mask: str) -> int:
    return int(mask, 2) * 0x9E3779B97F4A7C15 + len(mask) & (1 << 64) - 1


def _bench(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = batch.column("item_id").to_pylist()
        for rows, data, offsets in pieces(batch):
            ids, cuts = tokens(data, offsets)
            out = {"item_id": [], "n": [], "item_tokens": [], "seeds": []}
            for i, item in enumerate(items[rows]):
                own = ids[cuts[i] : cuts[i + 1]]
                masks = MASKS if len(own) >= SPAN else ["1" * len(own)] if len(own) else []
                out["item_id"].append(item)
                out["n"].append(len(own))
                out["item_tokens"].append(own.tobytes())
                out["seeds"].append([{"seed": int(k), "at": at, "span": min(len(own), SPAN)} for m in masks for at, k in enumerate(seed_keys(own, m).view(np.int64))])
            kind = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32()), ("span", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(out["item_id"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["item_tokens"], pa.binary()), pa.array(out["seeds"], kind)], names=list(out))


def prepare(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, item_tokens, seeds) of every item."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    return stored(items.mapInArrow(_bench, "item_id bigint, n int, item_tokens binary, seeds array<struct<seed: bigint, at: int, span: int>>"), "bench-items")


def seed_filter(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """(bit table of all seeds, lengths of the items of fewer than SPAN tokens). Tasks fold their seeds into one table each."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, short = np.zeros(1 << FILTER_BITS - 3, np.uint8), set()
        for batch in batches:
            slots = batch.column("seed").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            np.bitwise_or.at(bits, (slots >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slots & np.uint64(7)).astype(np.uint8))
            short.update(s for s in batch.column("span").to_pylist() if s < SPAN)
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits[at].astype(np.int16)), pa.array([0] * len(at), pa.int32())], names=["at", "bits", "span"])
        yield pa.RecordBatch.from_arrays([pa.array([-1] * len(short), pa.int32()), pa.array([0] * len(short), pa.int16()), pa.array(sorted(short), pa.int32())], names=["at", "bits", "span"])

    seeds = items.select(F.explode("seeds").alias("s")).select("s.seed", "s.span")
    cells = seeds.mapInArrow(fold, "at int, bits smallint, span int").groupBy("at", "span").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most 2^21 cells and SPAN lengths
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    some = cells[cells["at"] >= 0]
    bits[some["at"].to_numpy(np.int64)] = some["bits"].to_numpy().astype(np.uint8)
    return bits, sorted(int(s) for s in cells.loc[cells["at"] < 0, "span"])


def doc_key() -> Column:
    """doc_id without nulls; row tells null from zero."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc")


REGION = "doc bigint, row bigint, start int, doc_tokens binary, hits array<struct<seed: bigint, at: int>>"


def find_hits(docs: DataFrame, bits: np.ndarray, short: list[int]) -> DataFrame:
    """Stretches of documents around neighbouring seeds that may be the benchmark's, with their tokens."""
    settle(docs.sparkSession)
    shared = share(docs.sparkSession, bits)
    masks = [*MASKS, *("1" * n for n in short)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            names, keys_of = batch.column("doc"), batch.column("row")
            for rows, data, offsets in pieces(batch):
                ids, cuts = tokens(data, offsets)
                found_at, found = [], []
                for mask in masks:
                    keys = seed_keys(ids, mask)
                    slot = keys >> np.uint64(64 - FILTER_BITS)
                    at = np.flatnonzero(cells[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    row = np.searchsorted(cuts, at, side="right") - 1
                    at = at[at + len(mask) <= cuts[row + 1]]
                    found_at.append(at)
                    found.append(keys[at])
                at, key = np.concatenate(found_at), np.concatenate(found)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, key = at[order], key[order].view(np.int64)
                row = np.searchsorted(cuts, at, side="right") - 1
                heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] - at[:-1] > CONTEXT) | (at[1:] // REGION_TOKENS != at[:-1] // REGION_TOKENS)]))
                out = {"doc": [], "row": [], "start": [], "doc_tokens": [], "hits": []}
                for a, b in zip(heads, [*heads[1:], len(at)], strict=True):
                    low, high = max(cuts[row[a]], at[a] - CONTEXT), min(cuts[row[a] + 1], at[b - 1] + SPAN + CONTEXT)
                    out["doc"].append(names[rows.start + int(row[a])].as_py())
                    out["row"].append(keys_of[rows.start + int(row[a])].as_py())
                    out["start"].append(int(low - cuts[row[a]]))
                    out["doc_tokens"].append(ids[low:high].tobytes())
                    out["hits"].append([{"seed": int(k), "at": int(i - low)} for k, i in zip(key[a:b], at[a:b], strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(out["doc"], pa.int64()), pa.array(out["row"], pa.int64()), pa.array(out["start"], pa.int32()), pa.array(out["doc_tokens"], pa.binary()), pa.array(out["hits"], pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())])))], names=list(out))

    return docs.select(doc_key(), row_key().alias("row"), text_or_empty().alias("text")).mapInArrow(lean(run), REGION)


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> int:
    """Most places that agree in some LEAST consecutive places of the diagonal (doc = item + diagonal); 0 if too few do."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    width = min(LEAST, len(item))
    if high - low < width:
        return 0
    same = np.concatenate([[0], np.cumsum(doc[low + diagonal : high + diagonal] == item[low:high])])
    most = int((same[width:] - same[:-width]).max())
    need = int(np.ceil(SHARE * width)) if len(item) >= SPAN else width
    return most if most >= need else 0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, items, diagonals = (batch.column(c) for c in ("doc_tokens", "item_tokens", "diagonal"))
        best = [overlap(np.frombuffer(docs[i].as_py(), np.uint64), np.frombuffer(items[i].as_py(), np.uint64), diagonals[i].as_py()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "row", "item_id")), pa.array(best, pa.int32())], names=["doc", "row", "item_id", "agree"]).filter(pa.array([b > 0 for b in best]))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc, row, item_id, agree): verified overlaps of rows named by doc_key and row_key; agree is the most tokens that agree in a window."""
    items = prepare(benchmark)
    bits, short = seed_filter(items)
    regions = stored(find_hits(docs, bits, short), "bench-regions")
    hits = regions.select("doc", "row", "start", F.explode("hits").alias("h")).select("doc", "row", "start", "h.seed", "h.at")
    seeds = stored(items.select("item_id", F.explode("seeds").alias("s")).select("item_id", "s.seed", F.col("s.at").alias("item_at")), "bench-seeds")
    lines = hits.join(seeds, "seed").select("doc", "row", "start", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    lines = lines.join(regions.select("doc", "row", "start", "doc_tokens"), ["doc", "row", "start"]).join(items.select("item_id", "item_tokens"), "item_id")
    found = lines.select("doc", "row", "item_id", "diagonal", "doc_tokens", "item_tokens").mapInArrow(lean(_verify), "doc bigint, row bigint, item_id bigint, agree int")
    return found.groupBy("doc", "row", "item_id").agg(F.max("agree").alias("agree"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, row, contaminated, item_ids, agree) of every row of docs; row is its row_key."""
    by_doc = overlaps(docs, benchmark).groupBy("doc", "row").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("agree").cast("bigint").alias("agree"))
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), doc_key(), row_key().alias("row")).join(by_doc, ["doc", "row"], "left")
    return out.select("doc_id", "row", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("agree", F.lit(0).cast("bigint")).alias("agree"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")
