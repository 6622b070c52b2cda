"""Centroid clustering, periodic runs and token counts against brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tamis.llm import centroids, periodic_runs, registry, token_counts
from tamis.llm.common import scratch_path

SF = "/root/testdata/sf0.001"


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# ---- centroids --------------------------------------------------------------------------------------------
def clustered(rows, k=8, rounds=10, scale=1024):
    """The contract in plain integers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: ("1" if r[0] is None else "0", hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(c)), key=lambda i: (far(v, c[i]), i))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        for j in range(len(c)):
            if some := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                c[j] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    return sorted([(i, n := near(v), far(v, c[n])) for i, v in kept], key=repr), c


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, v int").repartition(3)


def got(out):
    return sorted([(r["vec_id"], r["cluster"], r["distance"]) for r in out.collect()], key=repr)


def test_centroids(spark):
    rng = np.random.default_rng(1)
    rows = [(i, list(map(float, rng.normal(size=64) * 0.2 + i % 5))) for i in range(120)]
    rows += [(200, None), (201, [1.0] * 63), (202, [float("nan")] * 64), (203, [float("inf")] * 64), (204, [None] * 64), (205, []), (3, rows[3][1]), (3, rows[3][1]), (None, rows[7][1])]
    out, c = centroids.cluster(vectors(spark, rows))
    want, far = clustered(rows)
    assert got(out) == want and c.tolist() == far


def test_centroids_ties_and_few_rows(spark):
    """Grids have very many equal distances, and four rows make four centroids at most."""
    rng = random.Random(4)
    grid = [(i, [rng.choice((-1.0, 0.0, 1.0)) / 1024 for _ in range(3)] + [0.0] * 61) for i in range(90)]
    for rows in (grid, grid[:4], [(i, [0.5] * 64) for i in range(30)], [(None, [0.5] * 64)], [(1, [9e4] * 64), (2, [-9e4] * 64), (3, [9e4] * 63 + [8.9999e4])]):
        out, c = centroids.cluster(vectors(spark, rows))
        want, far = clustered(rows)
        assert got(out) == want and c.tolist() == far


def test_centroids_of_nothing_and_of_too_much(spark):
    out, c = centroids.cluster(vectors(spark, []))
    assert out.count() == 0 and not len(c)
    with pytest.raises(PySparkException, match="a component is"):
        centroids.cluster(vectors(spark, [(1, [2e5] * 64)]))


def test_intervals_hold_the_exact_values():
    """The nearest centroid is never screened out, and most others are, even where values are large and centroids close."""
    rng = np.random.default_rng(2)
    for size in (300, 1 << 20, centroids.LARGEST - 1):
        c = rng.integers(-size, size, (8, 64))
        c[4:] = c[:4] + rng.integers(-1, 2, (4, 64))
        x = np.concatenate([rng.integers(-size, size, (500, 64)), c, (c[:4] + c[4:]) // 2]).astype(np.int64)
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x])
        left = centroids.shortlist(x, c)
        assert left[np.arange(len(x)), exact.argmin(axis=1)].all() and left.mean() < 0.4
        assert (centroids.nearest(x, c) == exact.argmin(axis=1)).all()


# ---- runs -------------------------------------------------------------------------------------------------
def all_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        at = None
        for i in range(n - q + 1):
            if i < n - q and words[i] == words[i + q]:
                at = i if at is None else at
            elif at is not None:
                if i + q - at >= max(6, 4 * q):
                    found.setdefault((at, i + q), q)
                at = None
    return sorted((a, b, q) for (a, b), q in found.items())


@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_runs_against_brute_force(letters):
    rng = random.Random(letters)
    texts = []
    for _ in range(300):
        words = [str(rng.randrange(letters)).encode() for _ in range(rng.choice((0, 3, 6, 7, 20, 60, 150)))]
        for _ in range(rng.randrange(4)):
            at, p, n = rng.randrange(len(words) + 1), rng.randint(1, 20), rng.randint(1, 120)
            part = [str(rng.randrange(letters)).encode() for _ in range(p)]
            words[at:at] = (part * n)[:n]
        texts.append(words)
    assert periodic_runs.piece_runs(texts) == [all_runs(w) for w in texts]
    assert sum(map(len, periodic_runs.piece_runs(texts))) > 100


def test_runs_of_fibonacci_words_and_powers():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 900:
        a, b = b, b + a
    nested = ([b"x"] * 8 + [b"y"]) * 9
    for words in (b, nested * 5 + [b"z"], [b"a"] * 1000, ([b"p", b"q"] * 250)[:-1]):
        assert periodic_runs.piece_runs([words]) == [all_runs(words)]


def test_runs_take_time_in_proportion():
    def seconds(n):
        began = time.time()
        periodic_runs.piece_runs([[b"a"] * n])
        periodic_runs.piece_runs([[b"a", b"b", b"c"] * (n // 3)])
        return time.time() - began

    seconds(1000)
    assert seconds(160_000) < 16 * max(seconds(20_000), 0.05)


def expected(doc_id, text):
    words = split(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    gone = {i for a, b, q in runs for i in range(a + q, b)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(((a - b, a, q) for a, b, q in runs), default=None)
    told = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (len(runs), *told, digest("".join(f"{a},{b - a},{q}\n" for a, b, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_of_documents(spark, documents, corpus, no_documents):
    more = spark.createDataFrame([(None, "a b " * 9, "x"), (None, None, "x"), (110, "k " * 30, "y"), (110, "k " * 30, "y"), (3, "l m\t" * 4 + "é " * 7, "z")], "doc_id bigint, text string, runs string")
    for docs in (documents, more, no_documents):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 20_000]
        small = docs.where("length(coalesce(text, '')) < 20000")
        small.select("doc_id", "text").write.mode("overwrite").parquet(path := scratch_path(spark, "runs"))
        table = periodic_runs.table
        try:
            periodic_runs.table = lambda s, d, n: small  # noqa: B023
            out = periodic_runs.query(spark, path).collect()
        finally:
            periodic_runs.table = table
        assert sorted([(r["doc_id"], *(r[c] for c in COLUMNS)) for r in out], key=repr) == sorted([(d, *expected(d, t)) for d, t in rows], key=repr)


def test_runs_of_the_table(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in periodic_runs.query(spark, SF).collect()}
    assert set(out) == set(rows) and sum(r[0] for r in out.values()) > 5
    short = {d: t for d, t in rows.items() if len(split(t)) < 1500}
    assert len(short) > 100 and {d: out[d] for d in short} == {d: expected(d, t) for d, t in short.items()}


# ---- tokens -----------------------------------------------------------------------------------------------
TOKENIZER = token_counts.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def whole(texts):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(encoder.encode(t or "", add_special_tokens=False)) for t in texts]


def test_pieces_count_as_whole_texts():
    rng = random.Random(6)
    parts = ["the", "don't", "'s", " ", "  ", "\n", "\t", " \n", " ", " ", "\x1c", "\x85", "​", "é", "１２", "7", "--", "!", "<|endoftext|>", "<|endof", "text|>", "日本語", "🙂", "A", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", " ", "x" * 5000, "a b " * 3000]
    assert token_counts.cuts_at_spaces(TOKENIZER[0])
    assert token_counts.Counter(TOKENIZER[0]).counts(texts) == whole(texts)


def test_tokenizers_that_cannot_be_cut():
    text, _ = token_counts.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    from tokenizers import Tokenizer

    counter, encoder = token_counts.Counter(text), Tokenizer.from_str(text)
    texts = ["Hello  World", "", "a b c\n\nd", "it's 12"]
    assert not counter.cut and counter.counts(texts) == [len(encoder.encode(t, add_special_tokens=False)) for t in texts]
    assert not token_counts.cuts_at_spaces(TOKENIZER[0].replace('"add_prefix_space":false', '"add_prefix_space":true'))


def test_token_counts(spark, documents, corpus, no_documents):
    cache = scratch_path(spark, "cache")
    want = sorted((d, len((t or "").encode()), n) for (d, t), n in zip(corpus, whole([t for _, t in corpus]), strict=True))
    for _ in range(2):  # into an empty cache, then from a full one
        out = token_counts.token_counts(documents, TOKENIZER, cache)
        assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in out.collect()) == want
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in corpus})
    assert token_counts.token_counts(no_documents, TOKENIZER, cache).count() == 0


def test_token_counts_encode_only_misses(spark):
    """Texts with a count are not encoded again: a wrong count in the cache shows. Another version has its own counts."""
    cache = scratch_path(spark, "cache")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "new text"), (None, None), (3, "")], "doc_id bigint, text string")
    spark.createDataFrame([("a b",)], "t string").select(token_counts.digest(F.col("t")).alias("digest"), F.lit(77).cast("bigint").alias("n_tokens")).write.parquet(f"{cache}/version={TOKENIZER[1]}")
    out = token_counts.token_counts(docs, TOKENIZER, cache)
    assert sorted([(r["doc_id"], r["n_tokens"]) for r in out.collect()], key=repr) == sorted([(1, 77), (1, 77), (None, 77), (2, 2), (None, 0), (3, 0)], key=repr)
    out = token_counts.token_counts(docs, (TOKENIZER[0], "other"), cache)
    assert sorted([(r["doc_id"], r["n_tokens"]) for r in out.collect()], key=repr) == sorted([(1, 2), (1, 2), (None, 2), (2, 2), (None, 0), (3, 0)], key=repr)
    assert spark.read.parquet(f"{cache}/version=other").count() == 3


def test_token_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.query(spark, SF).collect()}
    assert out == {r["doc_id"]: (len((r["text"] or "").encode()), n, n > 1024) for r, n in zip(rows, whole([r["text"] for r in rows]), strict=True)}


def test_these_are_registered():
    assert {"op11_centroids", "op12_periodic_runs", "op13_token_counts"} <= set(registry.queries())
    assert "op11_centroids" in registry.oracle_sql()
