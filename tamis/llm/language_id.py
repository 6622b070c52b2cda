"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of a bounded sample of labelled documents (about ``per_language`` of each
language, chosen by a hash of the identifier; the bound is a parameter), sums the counts with Spark and turns
them into class priors, from all labelled rows, and a matrix of log probabilities, buckets by languages. Every
language is learned: the number of buckets is halved until the matrix has at most ``MATRIX_BYTES`` (64 MiB), and
is then broadcast. Prediction is an Arrow UDF of the text alone, whole texts: numpy gathers the rows of the
matrix at every n-gram of a piece and sums them by document.

Null texts and texts without a letter are ``und`` with score 0, as is every text when nothing could be
learned. Rows with a null lang or null identifier are never trained on. Ties go to the first language by code
point. Repeated rows get the same prediction; extra columns are ignored; empty tables give no rows. More than
``MOST_LANGUAGES`` labels, which can't be languages, raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.arrays import cut, lean, pieces
from tamis.llm.common import settle, share, table

PER_LANGUAGE = 2000
MATRIX_BYTES = 1 << 26
BUCKET_BITS = 15
MOST_LANGUAGES = 1 << 15
ORDERS = (2, 3)
UNKNOWN = "und"

#: One-to-one lower-case folds below U+0250; other characters stay.
_FOLD = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x250)], dtype=np.uint32)
_LETTER = np.array([chr(i).isalpha() for i in range(0x250)])


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of UTF-8 bytes, and the rows' offsets in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = points.copy()
    low = points < len(_FOLD)
    points[low] = _FOLD[points[low]]
    points[low & ~_LETTER[np.minimum(points, len(_LETTER) - 1)]] = 32  # signs and digits tell nothing
    return points, leads[offsets]


def grams(points: np.ndarray, offsets: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at every character (those that would cross a row are bucket 0), and their mask."""
    n = max(0, len(points) - order + 1)
    h = np.zeros(n, dtype=np.uint32)
    for i in range(order):
        h = h * np.uint32(0x01000193) ^ (points[i : i + n] * np.uint32(0x9E3779B1))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    inside = np.ones(len(h), dtype=bool)
    for cut in range(1, order):
        at = offsets[1:-1] - cut
        inside[at[(at >= 0) & (at < len(inside))]] = False
    return (h >> np.uint32(32 - bits)).astype(np.int64), inside


def has_letter(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letter = _LETTER[np.minimum(points, len(_LETTER) - 1)]
    high = np.flatnonzero(points >= len(_LETTER))
    letter[high] = [chr(c).isalpha() for c in points[high]]
    total = np.concatenate([[0], np.cumsum(letter)])
    return total[offsets[1:]] > total[offsets[:-1]]


class Model(NamedTuple):
    """Languages, log-probability matrix (buckets of all orders by languages), log priors, bits of a bucket."""

    langs: list[str]
    logs: np.ndarray
    priors: np.ndarray
    bits: int


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_numpy()
        for rows, data, offsets in pieces(batch):
            points, cuts = characters(data, offsets)
            own = langs[rows]
            for lang in np.unique(own).tolist():
                seen = counts.setdefault(lang, np.zeros((len(ORDERS), 1 << bits), np.int64))
                of = np.repeat(own == lang, np.diff(cuts))
                for k, order in enumerate(ORDERS):
                    h, inside = grams(points, cuts, order, bits)
                    seen[k] += np.bincount(h[inside & of[: len(h)]], minlength=1 << bits)
    for lang, seen in counts.items():
        flat = seen.reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(lang * len(flat) + at), "n": pa.array(flat[at])})


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, bits: int = BUCKET_BITS) -> Model:
    """The model of rows of (doc_id, text, lang)."""
    settle(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null and doc_id is not null")
    there = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(there) > MOST_LANGUAGES:
        raise ValueError(f"there are more than {MOST_LANGUAGES} labels")
    langs = sorted(there, key=lambda x: [ord(c) for c in x])
    while bits > 1 and len(langs) * (len(ORDERS) << bits) * 4 > MATRIX_BYTES:
        bits -= 1
    buckets = len(ORDERS) << bits
    if not langs:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), bits)
    spot = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003))
    known = labelled.sparkSession.createDataFrame([(lang, i, int(1_000_003 * min(1.0, per_language / there[lang])) + 1) for i, lang in enumerate(langs)], "lang string, i int, upto int")
    sample = rows.join(F.broadcast(known), "lang").where(spot < F.col("upto")).select("text", F.col("i").alias("lang"))
    counts = sample.mapInArrow(lean(lambda b: _count(b, bits)), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = counts.toArrow()  # at most one for each cell of the matrix
    seen = np.zeros(len(langs) * buckets)
    seen[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    seen = seen.reshape(len(langs), buckets).T
    logs = np.empty_like(seen)
    for k in range(len(ORDERS)):
        own = slice(k << bits, (k + 1) << bits)
        logs[own] = np.log(seen[own] + 0.5) - np.log(seen[own].sum(axis=0) + 0.5 * (1 << bits))
    priors = np.log(np.array([there[x] for x in langs], float) / sum(there.values()))
    # the mean over languages says nothing; without it single-precision sums stay small
    return Model(langs, np.ascontiguousarray(logs - logs.mean(axis=1, keepdims=True), dtype=np.float32), priors, bits)


def score(data: np.ndarray, offsets: np.ndarray, logs: np.ndarray, priors: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(has a letter, best language, its posterior) for each row of a piece."""
    points, cuts = characters(data, offsets)
    n, langs = len(offsets) - 1, logs.shape[1]
    if not langs:
        return np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n)
    total = np.tile(priors, (n, 1))
    if len(points):
        for k, order in enumerate(ORDERS):
            h, inside = grams(points, cuts, order, bits)
            if len(h):
                value = logs[h + (k << bits)]
                value[~inside] = 0
                begins = np.minimum(cuts[:-1], len(h) - 1)
                part = np.add.reduceat(value, begins, axis=0, dtype=np.float64)
                part[np.diff(np.append(np.minimum(cuts[:-1], len(h)), min(cuts[-1], len(h)))) == 0] = 0
                total += part
    best = total.argmax(axis=1)
    return has_letter(points, cuts) if len(points) else np.zeros(n, bool), best, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)


def language(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct<lang_pred, score> of a text; the model is broadcast."""
    settle(spark)
    if model.logs.nbytes > MATRIX_BYTES:
        raise ValueError("the matrix is larger than what may be broadcast")
    shared = share(spark, model)

    @lean
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs, logs, priors, bits = shared.value
        names = [*langs, UNKNOWN]
        for column in columns:
            preds, scores = [], [np.zeros(0)]
            for _, data, offsets in cut(column, max(1 << 14, (1 << 20) // max(4, len(langs)))):
                letters, best, p = score(data, offsets, logs, priors, bits)
                preds += [names[i] for i in np.where(letters, best, len(langs))]
                scores.append(np.where(letters, p, 0.0))
            yield pa.StructArray.from_arrays([pa.array(preds, pa.string()), pa.array(np.concatenate(scores))], names=["lang_pred", "score"])

    return F.arrow_udf(run, "lang_pred string, score double", F.ArrowUDFType.SCALAR_ITER)(text)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), language(docs.sparkSession, model, F.col("text")).alias("l")).select("doc_id", "l.*")


def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text has a language with a posterior of ``least`` or more. No shuffle; only texts go to Python."""
    told = language(docs.sparkSession, model, F.col("text"))
    return docs.where((told["lang_pred"] != UNKNOWN) & (told["score"] >= least))


HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0"


def train_held_in(docs: DataFrame) -> Model:
    return train(docs.where(f"not ({HELD_OUT})").select("doc_id", "text", "lang"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = predict(docs, train_held_in(docs))
    return told.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "lang_pred", "score")
