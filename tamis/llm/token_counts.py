"""Token counts of texts with a digest cache: each different text is encoded once for each version of a tokenizer.

The cache is a Parquet table (digest of the text, tokens), in a folder for each version: the digest of the tokenizer's file,
its library's version and the options. A run

1. names every row by the SHA-256 of its text (null counts as empty; texts are not changed, as any change of white space
   or case may change the count);
2. groups the names, with the smallest doc_id of each as the row that stands for it, and joins the groups with the
   cache: what has no count is a miss;
3. encodes the rows that stand for misses, found by (digest, doc_id): the names are broadcast if there are few, else
   the join shuffles; rows alike in both are counted once by their task and once in the cache;
4. appends the counts to the cache and joins all names with them.

Digests are all that is shuffled in 2 and 4, summed up by digest before it, so copies cost a row a task; the last join
is between two stored tables, which adaptive execution splits where a digest is hot. A lost or repeated append can
at most repeat rows of the cache, which are grouped when read.

Encoding cuts a text where the tokenizer is bound to begin a token, before a single space between two characters that
are not white space, if the tokenizer's own splitting rule says so (``cuts_at_spaces``), and remembers counts of
the pieces in the task; others are encoded whole. Tests hold it against the library on whole texts.

Null texts have the count of the empty text, null and repeated doc_ids are rows like any others, extra columns are not
read, and an empty table gives an empty one and leaves the cache as it is.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.arrays import lean, pieces
from tamis.llm.common import scratch_path, settle, share, small, stored, table, text_or_empty

ENTRIES = "digest binary, n_tokens bigint"
#: Pieces of at most so many characters are remembered, so many of them.
PIECE_CHARS, PIECES = 64, 1 << 18
#: Bytes of texts that are taken together.
TOGETHER = 1 << 20

_BREAK = re.compile(r"(?<=\S)(?= \S)")


def read_tokenizer(path: str) -> tuple[str, str]:
    """(file of a ``tokenizers`` tokenizer as text, version): the same version gives the same counts."""
    import tokenizers

    with open(path, encoding="utf-8") as file:
        text = file.read()
    return text, hashlib.sha256(f"{tokenizers.__version__}\nno added tokens, whole texts\n{text}".encode()).hexdigest()


def cuts_at_spaces(text: str) -> bool:
    """Whether a token always begins before a single space that stands between characters that are not white space.

    So it is where texts are not normalised and are split by the byte-level rule, no part of which holds such a space
    but at its start, and where special strings hold no white space and don't take any in beside them.
    """
    rule = json.loads(text)
    split = rule.get("pre_tokenizer") or {}
    plain = all(not (re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in rule.get("added_tokens") or [])
    return plain and rule.get("normalizer") is None and rule.get("truncation") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)


class Counter:
    """Token counts by a tokenizer; remembers those of short pieces."""

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut = cuts_at_spaces(text)
        self.known: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.cut:
            return [n for text in texts for n in self.lengths([text])]
        if len(self.known) > PIECES:
            self.known.clear()
        known, out = self.known, []
        for text in texts:
            parts = _BREAK.split(text)
            new = [p for p in set(parts) if p not in known]
            fresh = dict(zip(new, self.lengths(new), strict=True))
            known.update(fresh)
            out.append(sum(map(known.__getitem__, parts)))
            for p in fresh:
                if len(p) > PIECE_CHARS:
                    del known[p]
        return out


#: Counters of this worker by version; workers live on from task to task.
_counters: dict[str, Counter] = {}


def counter(version: str, text: str) -> Counter:
    if version not in _counters:
        _counters.clear()
        _counters[version] = Counter(text)
    return _counters[version]


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def encode(misses: DataFrame, tokenizer: tuple[str, str]) -> DataFrame:
    """(digest, n_tokens) of (digest, text), one row for each digest."""
    rule, version = share(misses.sparkSession, tokenizer[0]), tokenizer[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or counter(version, rule.value)
            for rows, data, offsets in pieces(batch, limit=TOGETHER):
                names = batch.column("digest")[rows].to_pylist()
                first = {name: i for i, name in reversed(list(enumerate(names)))}
                texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in first.values()]
                yield pa.RecordBatch.from_pydict({"digest": pa.array(first, pa.binary()), "n_tokens": pa.array(count.counts(texts), pa.int64())})

    counted = misses.select("digest", "text").mapInArrow(lean(run), ENTRIES)
    return counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _folder(cache: str, version: str) -> str:
    return f"{cache.rstrip('/')}/version={version}"


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the cache has for a version; none where there is no cache yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(cache, version))
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ENTRIES)
    return spark.read.schema(ENTRIES).parquet(_folder(cache, version)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: tuple[str, str], cache: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of (doc_id, text); tokenizer from ``read_tokenizer``, cache a shared folder."""
    spark = docs.sparkSession
    settle(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn("digest", digest(F.col("text")))
    names = stored(rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "digest"), "token-names")
    groups = names.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    looked = stored(groups.join(cached(spark, cache, tokenizer[1]), "digest", "left"), "token-groups")
    misses = small(looked.where("n_tokens is null").select(F.col("digest").alias("missed"), "first_id"))
    stands = (F.col("digest") == F.col("missed")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    fresh = stored(encode(rows.join(misses, stands, "left_semi"), tokenizer), "token-counts")
    fresh.write.mode("append").parquet(_folder(cache, tokenizer[1]))
    counts = looked.where("n_tokens is not null").select("digest", "n_tokens").unionByName(fresh)
    return names.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


#: Longest text, in tokens, that a model takes at once.
LIMIT = 1024


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by the 50k byte-level vocabulary. The cache is a new folder below the shared one, so every text is a miss here."""
    import public_tokenizers

    tokenizer = read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    counts = token_counts(table(spark, sf_dir, "documents"), tokenizer, scratch_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
