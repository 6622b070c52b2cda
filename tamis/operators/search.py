"""Nearest of a large table of anchors for texts that are known beforehand: by the cosines of ``anchors``, without a stored model.

An n-gram of an anchor is never a row. Anchors are dealt into blocks of some MiB of text, and only the words of texts, the
distinct n-grams of blocks and the texts that are searched for are shuffled, so disk grows with the bytes of text:

1. Equal texts are one anchor, that of the first label and name. A task counts in how many anchors of its block each n-gram
   stands; summed over blocks, that gives every n-gram's idf, which is handed back to the blocks that have the n-gram.
2. A task gets its block's idfs, then its anchors, whose weights it works out and keeps, then all texts, a piece at a time.
   Products over n-grams that most have are one matrix product; over the others, sums over postings. All are exact to float64.
3. A block gives the best anchor of each text, and the best of blocks is taken.

The work is the product of both tables: each block meets all texts. A task holds a block's n-grams, its weights (about 12 bytes
for each n-gram of each anchor that any text has), ``DENSE_BYTES``, and a piece of the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis import scratch
from tamis.config import DEFAULT, Config
from tamis.operators.anchors import DECIMALS, counted_grams
from tamis.operators.classify import char_grams, folded

#: Bytes of words in a block; fewer, but not below the second, where that gives all cores something to do.
BLOCK_BYTES, LEAST_BYTES = 8 << 20, 2 << 20
#: Texts that are held against a block together.
TEXTS = 256
#: Memory of the weights that take part in the matrix product, and how many of its products take as long as one by postings.
DENSE_BYTES, DENSE_WORTH = 64 << 20, 100
#: N-grams that a task counts before it hands counts on, and places of a text that are looked at together.
COUNTED, PIECE = 1 << 20, 1 << 20
#: N-grams of 2 to 5 characters below the last one are numbers of 12 bits a character, others are kept as text.
SHORT, LONG, BITS, WIDE = 2, 5, 12, 1 << 12
_GRAM, _ANCHOR, _TEXT = 0, 1, 2


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, and the sum of its n."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[heads], np.add.reduceat(n, heads) if len(heads) else n


def gram_counts(text: str | None, config: Config = DEFAULT) -> tuple[np.ndarray, np.ndarray, Counter]:
    """(numbers of n-grams in order, how often each stands in the words of a folded text, the same of n-grams that have no number)."""
    words, low, high = (text or "").split(), config.nlp_ngram_min, config.nlp_ngram_max
    line, odd = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32), Counter()
    plain = (line < WIDE) & (line > 0)
    every = low < SHORT or high > LONG
    if every or not plain.all():
        for word, n in Counter(words).items():
            if every or not word.isascii() or "\0" in word:
                for gram in char_grams(word, low, high):
                    if not (SHORT <= len(gram) <= LONG and all(0 < ord(c) < WIDE for c in gram)):
                        odd[gram] += n
    parts = []
    for head in range(0, len(line) if words else 0, PIECE):
        c, ok = line[head : head + PIECE + LONG - 1].astype(np.int64), plain[head : head + PIECE + LONG - 1]
        key, fits, inner, found = c, ok, c != ord(" "), []
        for n in range(2, min(high, LONG, len(c)) + 1):
            m = len(c) - n + 1
            key, fits = key[:m] << BITS | c[n - 1 :], fits[:m] & ok[n - 1 :]
            if n > 2:
                fits &= inner[n - 2 : n - 2 + m]  # spaces stand at the ends only, so none spans two words
            if n >= low:
                found.append(key[:PIECE][fits[:PIECE]])
        each = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        heads = np.flatnonzero(np.diff(each, prepend=-1))
        parts.append((each[heads], np.diff(heads, append=len(each))))
    if len(parts) == 1:
        return *parts[0], odd
    keys, n = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
    return *_summed(keys, n), odd


def _spelled(keys: np.ndarray) -> list[str]:
    """The n-grams of numbers in order, which puts shorter ones first."""
    out = []
    for n in range(SHORT, LONG + 1):
        some = keys[np.searchsorted(keys, 1 << BITS * (n - 1)) : np.searchsorted(keys, 1 << BITS * n)]
        codes = np.stack([some >> BITS * (n - 1 - k) & (WIDE - 1) for k in range(n)], axis=1).astype(np.uint32)
        out += np.ascontiguousarray(codes).view(f"<U{n}").ravel().tolist()
    return out


def _numbered(grams: list[str]) -> np.ndarray:
    """The number of each n-gram, 0 if it has none."""
    size = np.fromiter(map(len, grams), np.int64, len(grams))
    codes = np.array(grams, f"<U{LONG}").view(np.uint32).reshape(-1, LONG).astype(np.int64)
    key = np.zeros(len(grams), np.int64)
    for k in range(LONG):
        key = np.where(codes[:, k] > 0, key << BITS | codes[:, k], key)
    return np.where((size >= SHORT) & (size <= LONG) & (codes < WIDE).all(axis=1) & ((codes > 0).sum(axis=1) == size), key, 0)


def _frequencies(batches: Iterator[pa.RecordBatch], config: Config) -> Iterator[pa.RecordBatch]:
    """(block, gram, n) of (block, words, copies): in how many anchors an n-gram stands; several rows to be added up where a block has many n-grams."""
    none = np.zeros(0, np.int64)
    block, keys, n, odd, new, size = None, none, none, Counter(), [], 0

    def counted() -> Iterator[pa.RecordBatch]:
        grams, each = [*_spelled(keys), *odd], np.concatenate([n, np.fromiter(odd.values(), np.int64, len(odd))])
        for head in range(0, len(grams), 1 << 14):
            some = grams[head : head + (1 << 14)]
            yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(some), pa.int32()), "gram": pa.array(some, pa.string()), "n": pa.array(each[head : head + len(some)])})

    for batch in batches:
        for at, words, copies in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "copies")), strict=True):
            if at != block or size > COUNTED:
                keys, n = _summed(np.concatenate([keys, *(k for k, _ in new)]), np.concatenate([n, *(np.full(len(k), c) for k, c in new)]))
                new, size = [], 0
                if at != block or len(keys) + len(odd) > COUNTED:
                    yield from counted()
                    block, keys, n, odd = at, none, none, Counter()
            own, _, rare = gram_counts(words, config)
            new.append((own, copies))
            size += len(own)
            for gram in rare:
                odd[gram] += copies
    keys, n = _summed(np.concatenate([keys, *(k for k, _ in new)]), np.concatenate([n, *(np.full(len(k), c) for k, c in new)]))
    yield from counted()


class Block:
    """The weights of a block's anchors, in the order that they are added in."""

    def __init__(self, config: Config) -> None:
        self.config, self.grams, self.named, self.rows, self.ready = config, [], [], [], False

    def know(self, grams: list[str], idf: np.ndarray, asked: np.ndarray) -> None:
        self.grams.append((_numbered(grams), grams, idf, asked))

    def _index(self) -> None:
        """No n-grams follow: places of n-grams are those of their numbers in order, then the others."""
        key, idf, asked = (np.concatenate([g[k] for g in self.grams]) if self.grams else np.zeros(0) for k in (0, 2, 3))
        order = np.argsort(key, kind="stable")
        order = np.concatenate([order[(rest := int((key == 0).sum())) :], order[:rest]])
        self.keys, self.idf, self.asked = key[order][: len(key) - rest], idf[order], asked[order]
        names = [g for part in self.grams for g in part[1]] if rest else []
        self.odd = {names[i]: len(self.keys) + k for k, i in enumerate(order[len(self.keys) :].tolist())}
        self.grams, self.ready = [], True

    def counts(self, words: str) -> tuple[np.ndarray, np.ndarray]:
        """(places of n-grams that the block has, how often each stands in a text)."""
        key, n, odd = gram_counts(words, self.config)
        at = np.searchsorted(self.keys, key)
        known = np.append(self.keys, -1)[at] == key
        at, n = at[known], n[known]
        more = [(self.odd[g], c) for g, c in odd.items() if g in self.odd]
        return (np.append(at, [p for p, _ in more]), np.append(n, [c for _, c in more])) if more else (at, n)

    def add(self, label: str, anchor: str | None, words: str) -> None:
        if not self.ready:
            self._index()
        number, n = self.counts(words)
        w = (1 + np.log(n)) * self.idf[number]
        kept = self.asked[number] > 0
        if kept.any():
            self.rows.append((np.full(kept.sum(), len(self.named), np.int32), number[kept].astype(np.int32), w[kept] / np.sqrt(w @ w)))
            self.named.append((label, anchor))

    def close(self, texts: int) -> None:
        """No anchors follow: the weights by n-gram, those of n-grams that most of so many texts and anchors have side by side."""
        row, number, w = (np.concatenate([r[k] for r in self.rows]) for k in range(3))
        self.rows, many = [], len(self.named)
        has = np.bincount(number, minlength=len(self.idf))
        worth = np.minimum(self.asked, texts) * has
        some = np.argsort(-worth, kind="stable")[: DENSE_BYTES // (8 * many)]
        some = some[worth[some] * DENSE_WORTH > texts * many]
        self.column = np.full(len(self.idf), -1, np.int32)
        self.column[some] = np.arange(len(some))
        dense = self.column[number] >= 0
        self.dense = np.zeros((len(some), many))
        self.dense[self.column[number[dense]], row[dense]] = w[dense]
        row, number, w = row[~dense], number[~dense], w[~dense]
        order = np.argsort(number, kind="stable")
        self.row, self.w = row[order], w[order]
        self.size = np.bincount(number, minlength=len(self.idf))
        self.start = np.cumsum(self.size) - self.size

    def cosines(self, texts: list[tuple[str, float]]) -> np.ndarray:
        """Of each of (words, norm) and each anchor."""
        common, rest = np.zeros((len(texts), len(self.dense))), []
        for k, (words, norm) in enumerate(texts):
            number, n = self.counts(words)
            q = (1 + np.log(n)) * self.idf[number] / norm
            column = self.column[number]
            common[k, column[column >= 0]] = q[column >= 0]
            rest.append((number[column < 0], q[column < 0]))
        out = common @ self.dense
        for k, (number, q) in enumerate(rest):
            size = self.size[number]
            if many := int(size.sum()):
                at = np.repeat(self.start[number] - np.cumsum(size) + size, size) + np.arange(many)
                out[k] += np.bincount(self.row[at], self.w[at] * np.repeat(q, size), out.shape[1])
        return out

    def best(self, keys: list[str], texts: list[tuple[str, float]]) -> pa.RecordBatch:
        scores = np.floor(self.cosines(texts) * 10**DECIMALS + 0.5) / 10**DECIMALS
        first = scores.argmax(axis=1)  # of equal ones that which was added first
        top = scores[np.arange(len(keys)), first]
        near = np.flatnonzero(top > 0)
        label, anchor = zip(*(self.named[first[i]] for i in near), strict=True) if len(near) else ((), ())
        return pa.RecordBatch.from_pydict({"key": pa.array([keys[i] for i in near], pa.string()), "score": pa.array(top[near]), "label": pa.array(label, pa.string()), "anchor": pa.array(anchor, pa.string())})


def _matches(batches: Iterator[pa.RecordBatch], texts: int, config: Config) -> Iterator[pa.RecordBatch]:
    """(key, score, label, anchor): each text's nearest anchor of a block. Rows of a block are its n-grams, its anchors and then texts."""
    block, held, keys, asked, open_ = None, Block(config), [], [], True
    for batch in batches:
        at, kind = (batch.column(c).to_numpy() for c in ("block", "kind"))
        bounds = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(at)]
        for head, tail in pairwise(bounds if len(at) else []):
            rows = batch.slice(head, tail - head)
            label, name, words = (rows.column(c).to_pylist() for c in ("label", "name", "words"))
            x, n = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("x", "n"))
            if at[head] != block:
                if keys:
                    yield held.best(keys, asked)
                block, held, keys, asked, open_ = at[head], Block(config), [], [], True
            if kind[head] == _GRAM:
                held.know(name, x, n)
            elif kind[head] == _ANCHOR:
                for row in zip(label, name, words, strict=True):
                    held.add(*row)
            elif held.named:
                if open_:
                    held.close(texts)
                    open_ = False
                for k in range(len(name)):
                    keys.append(name[k])
                    asked.append((words[k], x[k]))
                    if len(keys) == TEXTS:
                        yield held.best(keys, asked)
                        keys, asked = [], []
    if keys:
        yield held.best(keys, asked)


def nearest_of(texts: DataFrame, anchors: DataFrame, key: str = "ticket_id", text: str = "text", config: Config = DEFAULT) -> DataFrame:
    """(key, label, score, anchor) of each text's nearest of the anchors (anchor, label, text): what ``nearest_anchor`` gives for ``fit_anchors``.

    Ties go by label, then name; texts that are near to none have no row. Keys and anchors are told apart as there.
    """
    spark = anchors.sparkSession
    scratch.settle(spark)
    named = anchors.select(F.col("anchor").cast("string").alias("anchor"), F.col("label").cast("string").alias("label"), "text").where("label is not null and text is not null").withColumn("digest", F.sha2("text", 256))
    owners = named.select("digest", "label", "anchor").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("label", "anchor")).alias("who"))
    once = named.select("digest", "text").dropDuplicates(["digest"]).join(owners, "digest").select("digest", "who.label", "who.anchor", "copies", folded(F.col("text")).alias("words"))
    table = scratch.stored(once.withColumn("size", F.octet_length("words")), "anchors")
    many, size = table.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks = max(1, -(-size // BLOCK_BYTES), min(4 * spark.sparkContext.defaultParallelism, size // LEAST_BYTES))
    dealt = table.withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("int"))

    given = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null")
    grams = scratch.stored(counted_grams(given, "key", "text", config), "text-grams")
    asked = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("asked"))
    counted = dealt.select("block", "words", "copies").repartitionById(blocks, F.col("block")).mapInArrow(lambda batches: _frequencies(batches, config), "block int, gram string, n bigint")
    # a row for each n-gram, with the blocks that have it
    every = counted.repartition("gram").groupBy("gram").agg(F.sum("n").alias("n"), F.collect_set("block").alias("blocks"))
    known = scratch.stored(every.join(asked, "gram", "left").select("gram", "blocks", (F.log(F.lit(1 + many) / (1 + F.col("n"))) + 1).alias("idf"), F.coalesce("asked", F.lit(0)).alias("asked")), "gram-idfs")

    squares = grams.join(known.where("asked > 0").select("gram", "idf"), "gram").groupBy("key").agg(F.sqrt(F.sum(F.pow((1 + F.log("n")) * F.col("idf"), 2))).alias("norm"))
    whole = given.groupBy("key").agg(F.array_join(F.collect_list(folded(F.col("text"))), " ").alias("words"))
    wanted = scratch.stored(whole.join(squares, "key"), "texts")
    none = lambda kind: F.lit(None).cast(kind)
    rows = (
        known.select(F.explode("blocks").alias("block"), F.lit(_GRAM).alias("kind"), none("string").alias("label"), F.col("gram").alias("name"), none("string").alias("words"), F.col("idf").alias("x"), F.col("asked").alias("n"))
        .union(dealt.select("block", F.lit(_ANCHOR), "label", "anchor", "words", none("double"), none("bigint")))
        .union(wanted.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(_TEXT), none("string"), F.col("key").cast("string"), "words", "norm", none("bigint")))
    )
    count = wanted.count()
    near = rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind", "label", "name").mapInArrow(lambda batches: _matches(batches, count, config), "key string, score double, label string, anchor string")
    best = near.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("minus"), "label", "anchor")).alias("best"))
    kind = dict(given.dtypes)["key"]
    return best.select(F.col("key").cast(kind).alias(key), "best.label", (-F.col("best.minus")).alias("score"), "best.anchor")
