"""Incremental substring deduplication over words with a log-structured fingerprint index.

A window is ``width`` consecutive words. A word goes if a window that covers it has the same words as a window
that starts in a document with a smaller identifier.

The index is a list of immutable runs, each the fingerprints of one batch sorted by anchor (see ``passages``):
about one row for (width - gram) / 2 words. ``dedup_batch`` writes the new batch's run, merge-joins its buckets
with those of the historical runs, settles whole runs, refines the others to single windows, and returns the
batch. Hits are verified by 32 independent bits of the same words. ``compact`` merges
sorted runs into one and drops the fingerprints that can't decide anything any more: of equal runs the one of
the smallest identifier is enough. Refining needs the words of historical documents, so their table is passed.
``dedup`` takes a table as ``BATCHES`` batches by identifier, and compacts the index before each batch that meets
more than one run.

Null and empty texts have no words; texts of fewer words than a window keep all. Batches may come in any order
of identifiers, but a batch is judged against what came before it and itself only. Rows with a repeated doc_id
count as one document that starts the windows of all, each row cut by its own text; a null doc_id removes nothing
and is removed by nothing. Extra columns are ignored; empty tables give no rows. A text of 2^28 words or more is an
error, as places have so many bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import arrays
from tamis.llm.arrays import lean, pieces
from tamis.llm.common import drop_stored, name_rows, scratch_path, settle, stored, table
from tamis.llm.passages import ROW, RUNS, covered, find_runs, spans_by_doc, spans_of, window_ids, word_units

BATCHES = 3
WIDTH = 50
GRAM = 20


def flush(docs: DataFrame, path: str, width: int = WIDTH, gram: int = GRAM) -> str:
    """Write a batch's fingerprints as one immutable sorted run."""
    named = name_rows(docs, salted=True).where("doc_id is not null")
    find_runs(named, word_units, width, gram).sortWithinPartitions("anchor").write.parquet(path)
    return path


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(RUNS).parquet(*paths)


WHOLE = ["anchor", "whole", "check"]


def compact(spark: SparkSession, paths: list[str], to: str) -> str:
    """Merge runs into one: of runs alike as a whole, those of the smallest identifier stay."""
    first = read_runs(spark, paths).groupBy(*WHOLE).agg(F.min(F.struct(*ROW, "first", "last")).alias("head"))
    first.select("head.*", *WHOLE).repartitionByRange("anchor", "whole").sortWithinPartitions("anchor").write.parquet(to)
    return to


def repeated(batch: DataFrame, history: DataFrame | None = None, index: list[str] | None = None, width: int = WIDTH, gram: int = GRAM) -> tuple[DataFrame, str]:
    """((doc_id, text, spans) of the batch, path of its new run). history: documents of the runs in ``index``."""
    spark, named = batch.sparkSession, name_rows(batch, salted=True)
    new = flush(batch, scratch_path(spark, "window-run"), width, gram)
    own = read_runs(spark, [new]).withColumn("own", F.lit(True))
    runs = own.unionByName(read_runs(spark, index).withColumn("own", F.lit(False))) if index else own
    two = lambda name, of: (F.min(of).alias(f"{name}_low"), F.max(of).alias(f"{name}_high"))
    buckets = runs.groupBy("anchor").agg(*two("doc", "doc"), *two("whole", F.struct("whole", "check")), F.max("own").alias("any_own")).where("doc_low < doc_high and any_own")
    buckets = stored(buckets.select("anchor", (F.col("whole_low") != F.col("whole_high")).alias("mixed")), "window-buckets")
    matched = stored(runs.join(buckets, "anchor"), "window-hits")
    lowest = stored(matched.groupBy(*WHOLE).agg(F.min("doc").alias("low")), "window-lowest")
    hits = matched.join(lowest, WHOLE)
    settled = stored(hits.where("own and doc > low").select(*ROW, "first", "last"), "window-settled")
    asked = hits.where("mixed and doc = low").groupBy(*ROW).agg(F.collect_list(F.struct("first", "last")).alias("asked"))
    docs = named if history is None else named.unionByName(name_rows(history, salted=True))
    windows = stored(window_ids(docs.where("doc_id is not null").join(asked, ROW), word_units, width), "windows")
    again = windows.groupBy("bucket", "check").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").drop("high")
    again = stored(again, "windows-again")
    later = windows.join(again, ["bucket", "check"]).where("doc > low")
    spans = stored(spans_by_doc(settled, later), "window-spans")
    drop_stored(buckets, matched, lowest, settled, windows, again)
    return named.join(spans, ROW, "left").drop(*ROW), new


def keep(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """What is left of (doc_id, text, spans): n_words, n_removed, kept (words joined by a space, binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"doc_id": batch.column("doc_id"), "n_words": [], "n_removed": [], "kept": []}
            for rows, data, offsets in pieces(batch):
                starts, stops, cuts = arrays.words(data, offsets)
                for i in range(rows.start, rows.stop):
                    at, to = cuts[i - rows.start], cuts[i - rows.start + 1]
                    first, last = spans_of(batch, i)
                    gone = covered(to - at, width, first, last)
                    words = data[offsets[i - rows.start] : offsets[i - rows.start + 1]].tobytes().split()
                    out["n_words"].append(len(words))
                    out["n_removed"].append(int(gone.sum()))
                    out["kept"].append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if len(first) else b" ".join(words))
            yield pa.RecordBatch.from_arrays([out["doc_id"], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.binary())], names=list(out))

    settle(docs.sparkSession)
    return docs.select("doc_id", "text", "spans").mapInArrow(lean(run), "doc_id bigint, n_words bigint, n_removed bigint, kept binary")


def dedup_batch(batch: DataFrame, history: DataFrame | None = None, index: list[str] | None = None, width: int = WIDTH, gram: int = GRAM) -> tuple[DataFrame, list[str]]:
    """(what is left of the batch, the index with the batch's run)."""
    found, new = repeated(batch, history, index, width, gram)
    return keep(found, width), [*(index or []), new]


def dedup(docs: DataFrame, batches: int = BATCHES, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """What is left of every row of docs, taken in batches of rising identifiers; where they are cut doesn't change the result."""
    spark, id_ = docs.sparkSession, F.col("doc_id").cast("bigint")
    cuts = sorted(set(docs.agg(F.percentile_approx(id_, [i / batches for i in range(1, batches)])).first()[0] or [])) if batches > 1 else []
    parts, index, history = [], [], None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        above = id_ > low if low is not None else F.lit(True)
        batch = docs.where((above & (id_ <= high)) if high is not None else above | id_.isNull())
        if len(index) > 1:
            index = [compact(spark, index, scratch_path(spark, "window-merged"))]
        out, index = dedup_batch(batch, history, index, width, gram)
        parts.append(out)
        history = docs.where(id_ <= high) if high is not None else None
    return reduce(DataFrame.unionByName, parts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
with t as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as materialized (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from t where len(w) >= 50)),
low as (select h, min(doc_id) as d from win group by h having count(*) > 1),
gone as materialized (select distinct doc_id, i + k as p from (select win.doc_id, i from win join low using (h) where win.doc_id > low.d), range(50) r(k)),
kept as (select a.doc_id, string_agg(a.x, ' ' order by a.p) as x from (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from t) a anti join gone g on g.doc_id = a.doc_id and g.p = a.p group by a.doc_id),
n as (select doc_id, count(*) as n from gone group by doc_id)
select t.doc_id, cast(len(w) as bigint) as n_words, coalesce(n.n, 0) as n_removed, sha256(coalesce(kept.x, '')) as kept_sha256
from t left join n using (doc_id) left join kept using (doc_id)
"""
