"""Near-duplicate documents by b-bit MinHash.

``sketch`` reads every text once: distinct word shingles, ``HASHES`` minima of them, of which bands of
``ROWS`` are hashed for candidates and the low ``BITS`` bits are packed for the estimate. Documents with equal
shingle sets (two independent sums of the set's hashes) are one node.

Candidates, without listing pairs inside a band bucket:
1. every node of a bucket is paired with the bucket's leader, the node that shares buckets with most others, so
   the original of a family of copies;
2. links are confirmed on full shingle sets and joined into components; pairs inside one component can't change
   it. Only nodes of buckets that still span several components are paired across these, by their rare shingles
   (``cross_pairs``) and where the packed bits' collision-corrected estimate can reach the threshold.

At a similarity of 0.75, the bands miss a pair with probability (1 - 0.75^4)^32 = 5e-6, and the estimate,
cut ``MARGIN`` below the threshold, misses 2e-5 of those in step 2.

Null texts and texts without a word have no shingles and link with nothing; shorter texts than a shingle are
one shingle as a whole. Nodes have numbers of their own, given when the sketches are stored: rows with one doc_id
and different texts are documents of their own, repeated rows are one node. A null doc_id is returned, linked with
nothing. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.llm import arrays
from tamis.llm.arrays import Doubling, lean, pieces
from tamis.llm.common import row_key, settle, small, stored, table, text_or_empty
from tamis.llm.components import components

WORDS = 5
PERCENT = 75
HASHES, ROWS, BITS = 128, 4, 4
MARGIN = 0.17
#: Sizes of sets that differ by less than this factor are one class.
STEP = 1.1
SKETCH = "doc_id bigint, row bigint, n_shingles bigint, set_a bigint, set_b bigint, bits array<bigint>, bands array<bigint>"

_SEEDS = np.random.default_rng(8).integers(0, 1 << 32, size=(2, HASHES), dtype=np.uint32) | np.array([[0], [1]], dtype=np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle identifiers of each row of a piece, and their offsets. A-Z count as a-z."""
    data = arrays.LOWER[data]
    starts, stops, cuts = arrays.words(data, offsets)
    ids = arrays.word_ids(data, starts, stops)
    sizes = np.diff(cuts)
    n = np.where(sizes >= k, sizes - k + 1, (sizes > 0).astype(np.int64))
    row = np.repeat(np.arange(len(sizes)), n)
    at = np.repeat(cuts[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    value = np.zeros(len(at), dtype=np.uint64)
    levels = Doubling(ids, k)
    full = sizes[row] >= k
    if full.any():
        value[full] = levels.at(at[full], k)
    for i in np.flatnonzero(~full):  # at most one for each short text
        value[i] = reduce(lambda a, b: arrays.pair(a, b, 99), (ids[j : j + 1] for j in range(at[i], cuts[row[i] + 1])))[0]
    order = np.lexsort((value, row))
    row, value = row[order], arrays.finish(value[order])
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[keep], np.searchsorted(row[keep], np.arange(len(sizes) + 1))


def minima(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """HASHES minima, 32 bits each, for every row with shingles."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    begins = cuts[:-1][np.diff(cuts) > 0]
    out = np.empty((len(begins), HASHES), dtype=np.uint32)
    for h in range(HASHES):
        y = x ^ _SEEDS[0, h]
        y *= _SEEDS[1, h]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[:, h] = np.minimum.reduceat(y, begins)
    return out


def sketch(docs: DataFrame, k: int = WORDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                values, cuts = shingles(data, offsets, k)
                n = np.diff(cuts)
                some = n > 0
                sums = [np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)]
                bits, bands = np.zeros((len(n), HASHES * BITS // 64), np.uint64), np.zeros((len(n), HASHES // ROWS), np.uint64)
                if some.any():
                    begins = cuts[:-1][some]
                    sums[0][some] = np.add.reduceat(values, begins)
                    sums[1][some] = np.add.reduceat(arrays.finish(values ^ np.uint64(0x5851F42D4C957F2D)), begins)
                    low = minima(values, cuts)
                    nibbles = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(low), -1, 64 // BITS)
                    bits[some] = (nibbles << np.arange(0, 64, BITS, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
                    parts = low.astype(np.uint64).reshape(len(low), -1, ROWS)
                    key = np.arange(parts.shape[1], dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                    for r in range(ROWS):
                        key = arrays.pair(key, parts[:, :, r].copy(), r + 3)
                    bands[some] = key
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows], batch.column("row")[rows], pa.array(n.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in sums), lists(bits), lists(bands)], names=["doc_id", "row", "n_shingles", "set_a", "set_b", "bits", "bands"])

    settle(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row"), "text").mapInArrow(lean(run), SKETCH)


def texts_of(docs: DataFrame, nodes: DataFrame, repeated: bool) -> DataFrame:
    """(node, text) of nodes (node, doc_id, row); of repeated rows one."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row"), text_or_empty().alias("text"))
    found = own.join(small(stored(nodes.select("node", "doc_id", "row"), "minhash-wanted")), ["doc_id", "row"]).select("node", "text")
    return stored(found.dropDuplicates(["node"]) if repeated else found, "minhash-texts")


def shingle_rows(texts: DataFrame, k: int = WORDS) -> DataFrame:
    """(node, shingle) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("node").to_numpy()
            for rows, data, offsets in pieces(batch):
                values, cuts = shingles(data, offsets, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[rows], np.diff(cuts))), pa.array(values.view(np.int64))], names=["node", "shingle"])

    return texts.mapInArrow(lean(run), "node bigint, shingle bigint")


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(STEP))).cast("int")


def cross_pairs(nodes: DataFrame, texts: DataFrame, least: float, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b): nodes (node, component, bits, n) of different components that may be similar enough. Loses none on the sets' side.

    Shingles are put in one order, rare ones first. Two sets can only reach the threshold if their first common
    shingle is early enough in both: what comes from there on bounds the intersection. Copies with edits of their
    own start with these, so they meet only nodes that share an edit, not their whole family. The same bound tells
    how large a partner can be: with I common shingles at most, sets of n and m reach the threshold only if
    m <= I (100 + percent) / percent - n. Nodes meet by (shingle, class of the partner's size), so documents of one
    template that are too different for each other don't meet at the template's shingles, however many they are.
    """
    rows = stored(shingle_rows(texts, k), "minhash-shingles")
    common = stored(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "minhash-common")
    ordered = Window.partitionBy("node").orderBy("df", "shingle")
    shared = rows.join(common, "shingle").join(nodes, "node").select("*", F.row_number().over(ordered).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("node")).alias("shared"))
    # shingles that no other node has come first and are in no intersection
    reach = shared.select("node", "component", "bits", "n", "shingle", (F.col("shared") - F.col("rank") + 1).alias("reach")).where(100 * F.col("reach") >= percent * F.col("n"))
    reach = stored(reach, "minhash-prefixes")
    mixed = stored(reach.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle"), "minhash-mixed")
    met = stored(reach.join(mixed, "shingle", "left_semi"), "minhash-met")
    least_size, most_size = F.expr(f"({percent} * n + 99) div 100"), F.expr(f"({100 + percent} * reach) div {percent} - n")
    x = met.where(least_size <= most_size).withColumn("size", F.explode(F.sequence(size_class(least_size), size_class(most_size))))
    y = met.select("shingle", size_class(F.col("n")).alias("size"), *(F.col(c).alias(f"other_{c}") for c in ("node", "component", "bits", "n", "reach")))
    most = F.least("reach", "other_reach")
    able = 100 * most >= percent * (F.col("n") + F.col("other_n") - most)
    found = x.join(y, (x["shingle"] == y["shingle"]) & (x["size"] == y["size"]) & (F.col("component") < F.col("other_component")) & able & (estimate(F.col("bits"), F.col("other_bits")) >= least))
    return found.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed minima: the share of equal ones, corrected for chance equality of BITS bits."""
    ones = F.lit(int("1" * (64 // BITS), 1 << BITS))

    def differing(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        step = 1
        while step < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        return F.bit_count(x.bitwiseAND(ones))

    equal = 1 - sum((differing(i) for i in range(HASHES * BITS // 64)), F.lit(0)) / F.lit(float(HASHES))
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def confirm(pairs: DataFrame, texts: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # of bounded bytes
            right = pieces(batch, text="text_b", limit=1 << 62)
            _, data_b, offsets_b = next(right, (None, None, None))
            for rows, data, offsets in pieces(batch, text="text_a"):
                sets, cuts = shingles(data, offsets, k)
                part = offsets_b[rows.start : rows.stop + 1]
                other, ends = shingles(data_b[part[0] : part[-1]], part - part[0], k)
                ok = []
                for i in range(rows.stop - rows.start):
                    x, y = sets[cuts[i] : cuts[i + 1]], other[ends[i] : ends[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield batch.slice(rows.start, rows.stop - rows.start).select(["a", "b"]).filter(pa.array(ok))

    settle(pairs.sparkSession)
    rows = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a bigint, b bigint")


def cluster(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, kept) of every row of docs; row is its row_key."""
    least = percent / 100 - MARGIN
    sketches = stored(sketch(docs, k).withColumn("node", F.monotonically_increasing_id()), "minhash-sketches")
    usable = sketches.where("n_shingles > 0 and doc_id is not null")
    repeated = not usable.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    same = stored(usable.groupBy("set_a", "set_b").agg(F.min("node").alias("node"), F.min("doc_id").alias("low")), "minhash-nodes")
    nodes = usable.join(same.select("node"), "node", "left_semi")
    bands = nodes.select("node", F.explode("bands").alias("band"))
    shared = stored(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "minhash-buckets")
    members = stored(bands.join(shared, "band"), "minhash-members")
    fame = stored(members.groupBy("node").agg(F.sum("n").alias("fame")), "minhash-fame")
    members = stored(members.select("node", "band").join(fame, "node").join(nodes.select("node", "bits"), "node"), "minhash-members")
    leaders = stored(members.groupBy("band").agg(F.min(F.struct((-F.col("fame")).alias("f"), F.col("node").alias("leader"), F.col("bits").alias("leader_bits"))).alias("top")).select("band", "top.leader", "top.leader_bits"), "minhash-leaders")
    star = members.join(leaders, "band").where((F.col("node") != F.col("leader")) & (estimate(F.col("bits"), F.col("leader_bits")) >= least))
    star = stored(star.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "minhash-star")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    links = stored(confirm(star, texts_of(docs, nodes.join(ends(star), "node"), repeated), k, percent), "minhash-links")
    part = components(links)
    # buckets that still span components
    placed = members.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = stored(placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band"), "minhash-split")
    placed = stored(placed.join(split, "band", "left_semi").select("band", "node", "component", "bits"), "minhash-placed")
    left = stored(placed.select("node", "component", "bits").distinct().join(nodes.select("node", F.col("n_shingles").alias("n"), "doc_id", "row"), "node"), "minhash-left")
    texts = texts_of(docs, left, repeated)
    cross = cross_pairs(left.drop("doc_id", "row"), texts, least, k, percent)
    cross = cross.join(star, ["a", "b"], "left_anti")
    more = stored(confirm(stored(cross, "minhash-cross"), texts, k, percent), "minhash-links")
    part = components(links.unionByName(more))
    groups = stored(same.join(part, "node", "left").select("set_a", "set_b", "low", F.coalesce("component", "node").alias("component")), "minhash-groups")
    lowest = stored(groups.groupBy("component").agg(F.min("low").alias("component_id")), "minhash-components")
    groups = groups.join(lowest, "component").select("set_a", "set_b", "component_id")
    out = sketches.select("doc_id", "row", "n_shingles", "set_a", "set_b").join(groups, ["set_a", "set_b"], "left")
    id_ = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    id_ = F.when(F.col("doc_id").isNotNull(), id_)
    return out.select("doc_id", "row", "n_shingles", id_.alias("component_id"), id_.eqNullSafe(F.col("doc_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents")).drop("row")


SQL = r"""
with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (
  select distinct doc_id, md5(array_to_string(w[i:i + 4], ' ')) as h from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
links as materialized (
  select p.x, p.y from (select l.doc_id as x, r.doc_id as y, count(*) as both from s l join s r on l.h = r.h and l.doc_id < r.doc_id group by l.doc_id, r.doc_id) p
  join n nx on nx.doc_id = p.x join n ny on ny.doc_id = p.y where 100 * p.both >= 75 * (nx.n + ny.n - p.both)),
reach as (
  select x as doc_id, y as other from links union select y, x from links
  union
  select r.doc_id, l.other from reach r join (select x, y as other from links union all select y, x from links) l on l.x = r.other),
low as (select doc_id, min(other) as m from reach group by doc_id)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(low.m, w.doc_id)) as component_id, w.doc_id <= coalesce(low.m, w.doc_id) as kept
from w left join n using (doc_id) left join low using (doc_id)
"""
