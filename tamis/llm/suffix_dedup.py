"""Suffix-array deduplication by bucket-pointer refinement, over bytes.

A byte goes if a ``width``-byte string that covers it also starts anywhere else, in the same document or
another. Suffixes are put into buckets by their first ``GRAM`` bytes, only suffixes at sampled anchors at first;
buckets with more members are refined by the identifiers of the buckets at later offsets until they tell
``width`` bytes apart, each length from the identifiers of half the length (see ``passages``).

Null and empty texts have no bytes; texts shorter than ``width`` keep all; matches never cross documents;
copies of a document remove each other (both go), as both start elsewhere. Every row is a document of its own, also
with a null doc_id or one that other rows have too; equal rows are copies of each other. Extra columns are
ignored; empty tables give no rows. A text of 2^28 bytes or more is an error, as places have so many bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.arrays import lean
from tamis.llm.common import drop_stored, name_rows, odd_names, settle, stored, table
from tamis.llm.passages import ROW, byte_units, covered, find_runs, spans_by_doc, spans_of, window_ids

WIDTH = 200
GRAM = 100


def repeated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text, spans): window starts of each text that occur elsewhere too, as runs."""
    docs = name_rows(docs, odd_names(docs))
    whole = ["anchor", "whole", "check"]
    runs = stored(find_runs(docs, byte_units, width, gram), "suffix-runs")
    name = F.struct("whole", "check")
    buckets = stored(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "suffix-buckets")
    hits = stored(runs.join(buckets, "anchor"), "suffix-hits")
    drop_stored(runs, buckets)
    refined = stored(hits.groupBy(*whole, "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ROW, "first", "last")).alias("head")), "suffix-refined")
    settled = stored(hits.join(refined.where("n > 1").select(*whole), whole, "left_semi").select(*ROW, "first", "last"), "suffix-settled")
    drop_stored(hits)
    # of runs alike as a whole, one stands for all where it must be compared window by window
    asked = refined.where("mixed").groupBy("head.doc", "head.row").agg(F.collect_list(F.struct("head.first", "head.last")).alias("asked"))
    windows = stored(window_ids(docs.join(asked, ROW), byte_units, width), "suffix-windows")
    again = stored(windows.groupBy("bucket", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "check"), "suffix-again")
    spans = stored(spans_by_doc(settled, windows.join(again, ["bucket", "check"], "left_semi")), "suffix-spans")
    drop_stored(refined, settled, windows, again)
    return docs.join(spans, ROW, "left").drop(*ROW)


def keep(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """What is left of (doc_id, text, spans): n_bytes, n_removed, n_spans, kept (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            out = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for i, text in enumerate(texts):
                data = np.frombuffer(text.as_py(), dtype=np.uint8)
                first, last = spans_of(batch, i)
                gone = covered(len(data), width, first, last)
                out["n_bytes"].append(len(data))
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
                out["kept"].append(data[~gone].tobytes() if len(first) else text.as_py())
            yield pa.RecordBatch.from_arrays([out["doc_id"], *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary())], names=list(out))

    settle(docs.sparkSession)
    return docs.select("doc_id", "text", "spans").mapInArrow(lean(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keep(repeated(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
with t as materialized (select doc_id, hex(encode(coalesce(text, ''))) as b from documents),
win as materialized (select doc_id, i, md5(substr(b, cast(2 * i + 1 as integer), 400)) as h from (select doc_id, b, unnest(range(0, length(b) // 2 - 199)) as i from t where length(b) >= 400)),
twice as (select h from win group by h having count(*) > 1),
starts as materialized (select doc_id, i, row_number() over (partition by doc_id order by i) as r, case when i > lag(i) over (partition by doc_id order by i) + 200 then 1 else 0 end as cut from win semi join twice using (h)),
runs as materialized (select doc_id, s, min(i) as a, max(i) + 200 as z from (select *, sum(cut) over (partition by doc_id order by i) as s from starts) group by doc_id, s),
told as (select doc_id, count(*) as n_spans, sum(z - a) as n_removed from runs group by doc_id),
holes as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as before from runs),
kept as (select h.doc_id, string_agg(substr(t.b, cast(2 * before + 1 as integer), cast(2 * (a - before) as integer)), '' order by a) as x, max(z) as z from holes h join t using (doc_id) group by h.doc_id)
select t.doc_id, cast(length(t.b) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(kept.x || substr(t.b, cast(2 * kept.z + 1 as integer)), t.b))) as kept_sha256
from t left join told using (doc_id) left join kept using (doc_id)
"""
