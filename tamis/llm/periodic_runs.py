"""Periodic runs of words in texts, by Main and Lorentz's divide and conquer on interned word identifiers.

A run is a stretch of words that repeats itself with its smallest period q, is ``LEAST`` words and ``EXPONENT`` periods
long at least, and can't be made longer. Each task takes pieces of texts, numbers their different words, and lays the
texts of a piece end to end with a word between them that occurs once, so that no run goes from one text to the next.

1. *Divide.* Midpoints of one level are the odd multiples of ``half``, for half = 4, 8, 16, ...; the run is found at the
   midpoint of the highest level inside it, and so lies within ``half`` words to either side, with q <= half / 2. A run
   has at least half of its words on one side of its midpoint, which are two periods or more: that side starts with
   words that come again q words on. A first look at all (midpoint, q) of a level, side by side in numpy, compares up to
   ``LOOK`` words and leaves few midpoints; a level has n / 4 such pairs, however long the texts are.
2. *Conquer.* For these midpoints the Z-function of their side tells for every q how far it repeats. Where that is q
   words or more, the stretch is extended beyond the midpoint to where it ends. The left side is the right side of the
   reversed words.
3. *Keep.* Stretches that go beyond the midpoint's own words belong to a higher level. A stretch of period q that lies in
   one of smaller period is a multiple of it and is passed over. Of equal intervals the smallest period stays.

All of it costs O(n log n) for n words. Rows are independent: nothing is shuffled, and a task holds one piece (or one
text, if longer). Null and empty texts have no words and no run. Rows with equal or null identifiers are rows like any
others, extra columns are not read, and an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.arrays import lean, pieces
from tamis.llm.common import settle, table

LEAST, EXPONENT = 6, 4
#: Words that the first look compares.
LOOK = 8

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: (doc_id, words of its text) -> the words to take in their place
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def z_function(ids: list[int], upto: int) -> list[int]:
    """For each place below ``upto``: how many words from there on are those that ids starts with."""
    n = len(ids)
    z = [0] * upto
    left = right = 0
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and ids[k] == ids[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def likely(ids: np.ndarray, middles: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(midpoint, period) where the words from a midpoint on come again a period later, as far as ``LOOK`` words tell."""
    periods = np.arange(1, most + 1)
    same = ids[middles][:, None] == np.take(ids, middles[:, None] + periods, mode="clip")
    i, q = same.nonzero()
    c, q = middles[i], periods[q]
    for t in range(1, LOOK):
        if not len(c):
            break
        keep = (t >= np.maximum(q, 2)) | (np.take(ids, c + t, mode="clip") == np.take(ids, c + q + t, mode="clip"))
        c, q = c[keep], q[keep]
    return c, q


def repeats_back(ids: np.ndarray, c: int, q: int, most: int) -> int:
    """Words before c that come again q words on, counted back from c, ``most`` at most."""
    size, done = 16, 0
    while done < most:
        n = min(size, most - done)
        at = c - done
        differ = np.flatnonzero(ids[at - n : at] != ids[at - n + q : at + q])
        if len(differ):
            return done + n - 1 - int(differ[-1])
        done, size = done + n, size * 4
    return done


def right_runs(ids: np.ndarray, middles: np.ndarray, half: int, most: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of runs with half or more of their words from their midpoint on. ids ends in a word of its own."""
    c_all, q_all = likely(ids, middles, most)
    cuts = np.append(np.flatnonzero(np.diff(c_all, prepend=-1)), len(c_all))
    for at, to in zip(cuts[:-1], cuts[1:], strict=True):
        c, periods = int(c_all[at]), q_all[at:to].tolist()
        z = z_function(ids[c : c + half].tolist(), min(half, len(ids) - c, periods[-1] + 1))
        upto = 0
        for q in periods:
            if q >= len(z) or z[q] < q or c + 2 * q <= upto:
                continue
            end = upto = c + q + z[q]
            if end == c + half and end < len(ids) and ids[end] == ids[end - q]:
                continue  # goes on beyond this midpoint's words
            room = min(half, c)
            back = repeats_back(ids, c, q, room)
            if back == half and c > half and ids[c - half - 1] == ids[c - half - 1 + q]:
                continue
            if end - (c - back) >= max(LEAST, EXPONENT * q):
                yield c - back, end, q


def find_runs(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of ids by start, then period; no run is longer than ``longest``."""
    n = len(ids)
    ends = np.array([-1])
    forth, back = np.concatenate([ids, ends]), np.concatenate([ids[::-1], ends])
    found: dict[tuple[int, int], int] = {}
    half = 4
    while half < n:
        middles = np.arange(half, n, 2 * half)
        most = min(half // 2, longest // EXPONENT)
        if most:
            runs = list(right_runs(forth, middles, half, most))
            runs += [(n - end, n - start, q) for start, end, q in right_runs(back, (n - middles)[::-1], half, most)]
            for start, end, q in runs:
                found[start, end] = min(q, found.get((start, end), q))
        half *= 2
    return sorted((start, end, q) for (start, end), q in found.items())


def piece_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, given as words; places count from the text's first word."""
    number: dict[bytes, int] = {}
    ids, heads = [], []
    for i, words in enumerate(texts):
        heads.append(len(ids))
        ids += [number.setdefault(w, len(number)) for w in words]
        ids.append(-2 - i)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = find_runs(np.array(ids, dtype=np.int64), max(map(len, texts), default=0))
    for (start, end, q), i in zip(runs, np.searchsorted(heads, [r[0] for r in runs], side="right") - 1, strict=True):
        out[i].append((start - heads[i], end - heads[i], q))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those of a run after its first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, end, q in runs:
        kept[start + q : end] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, n_words, runs by start, then period, collapsed text) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                ids = batch.column("doc_id")[rows]
                texts = [data[a:b].tobytes().split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                if rewrite:
                    texts = [rewrite(d, words) for d, words in zip(ids.to_pylist(), texts, strict=True)]
                found = piece_runs(texts)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids,
                    "n_words": pa.array([len(words) for words in texts], pa.int64()),
                    "runs": pa.array([[{"start": a, "length": b - a, "period": q} for a, b, q in runs] for runs in found], _RUN),
                    "collapsed": pa.array([collapse(words, runs) for words, runs in zip(texts, found, strict=True)], pa.binary()),
                })

    settle(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lean(run), f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's periodic tails: a tenth of the documents, told by the checksum of their identifier, end in one. Null has none."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of runs, the longest, and digests of all runs and of the collapsed texts."""
    found = periodic_runs(table(spark, sf_dir, "documents"), planted)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"], r["period"])))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.minus")
    return rows.select("doc_id", "n_runs", "best.start", length.alias("length"), "best.period", F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
