"""Nearest anchor by TF-IDF cosine with anchors in a table of any size: fitted and scored by Spark.

``classify`` fits its 33 fixed anchors on the driver. Here vocabulary, document frequencies and weights are tables.
Anchors are dealt into blocks of ``WIDTH`` places, and the model has a row for each n-gram and block with the weights
of that block's anchors side by side, so that a text's products with a block are sums of one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis import scratch
from tamis.config import DEFAULT, Config
from tamis.functions.text import let
from tamis.operators.classify import with_grams, words_of

#: Anchors of a block: so many sums still make short compiled code; 64 took a third as long again (31 s against 23 s to fit at sf0.01).
WIDTH = 16
#: Anchors that are numbered together, about: a bucket is one sort, of keys only.
BUCKET = 4096
#: Rows of the model that are sent to all tasks: at most 32,768 * (8 * WIDTH + about 100) bytes, or 7 MiB.
BROADCAST_ROWS = 1 << 15
#: Counts of texts' n-grams that are sent to all tasks: about 100 bytes each, or 25 MiB.
BROADCAST_COUNTS = 1 << 18
#: Cosines are ranked by this many decimals, so that equal ones tie in whatever order they were summed.
DECIMALS = 9


@dataclass(frozen=True)
class AnchorModel:
    """cells(gram, block, idf, first, weights array<double>), and places(block, place, anchor, label); ``first`` marks one row of each gram."""

    cells: DataFrame
    places: DataFrame
    rows: int
    config: Config


def counted_grams(texts: DataFrame, key: str, text: str, config: Config, only: DataFrame | None = None) -> DataFrame:
    """(key, gram, n): how often each n-gram, or each of only (gram), a small table, stands in the words of a text. Null and blank texts have none."""
    # one exchange, by key, for this and all sums by key that follow; of a set number, as few bytes of text are many n-grams
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = texts.select(key, text).repartition(tasks, F.col(key)).select(key, F.explode_outer(words_of(F.col(text))).alias("word")).where("word is not null")
    counted = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    grams = with_grams(counted, config)
    if only is not None:
        grams = grams.join(F.broadcast(only), "gram", "left_semi")
    return grams.groupBy(key, "gram").agg(F.sum("n").alias("n"))


def fit_anchors(anchors: DataFrame, anchor: str = "anchor", label: str = "label", text: str = "text", config: Config = DEFAULT) -> AnchorModel:
    """The model of (anchor, label, text): smooth idf, sublinear counts, anchors of length one.

    Anchors are named by a key that may repeat: rows that are alike in all three count once, others are anchors of their own. Rows
    without a label or text are left out; a blank text is an anchor that nothing is near to, yet counts in the idf. An empty table
    gives a model without rows. Further columns are not read. The work of a fit is stored in the shared folder.
    """
    spark = anchors.sparkSession
    named = anchors.select(F.col(anchor).cast("string").alias("anchor"), F.col(label).cast("string").alias("label"), F.col(text).alias("text")).where("label is not null and text is not null")
    keyed = named.withColumn("key", F.sha2(F.to_json(F.struct("anchor", "label", "text")), 256)).dropDuplicates(["key"])
    table = scratch.stored(keyed, "anchors")
    many = table.count()
    order = Window.partitionBy("bucket").orderBy("label", "anchor", "key")
    numbered = table.select("key", "anchor", "label", F.pmod(F.xxhash64("key"), F.lit(-(-many // BUCKET) or 1)).alias("bucket")).withColumn("number", F.row_number().over(order) - 1)
    slots = scratch.stored(numbered.select("key", (F.shiftleft(F.col("bucket").cast("bigint"), 32) + F.col("number")).alias("slot"), "anchor", "label"), "places")
    block, place = F.expr(f"slot div {WIDTH}").alias("block"), (F.col("slot") % WIDTH).cast("int").alias("place")

    grams = scratch.stored(counted_grams(table.join(slots.select("key", "slot"), "key"), "slot", "text", config), "anchor-grams").select("slot", block, place, "gram", "n")
    known = grams.groupBy("gram").agg((F.log(F.lit(1 + many) / (1 + F.count(F.lit(1)))) + 1).alias("idf"), F.min("block").alias("head"))
    raw = grams.join(known, "gram").withColumn("w", (1 + F.log("n")) * F.col("idf"))
    # one exchange, by block, for the norms, the cells and the texts' sums over them
    unit = raw.repartition("block").withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("block", "slot")))).withColumn("w", F.col("w") / F.col("norm"))
    side = [F.sum(F.when(F.col("place") == k, F.col("w"))).alias(f"w{k}") for k in range(WIDTH)]
    held = unit.groupBy("gram", "block", "idf", (F.col("block") == F.col("head")).alias("first")).agg(*side)
    weights = F.array(*(F.coalesce(f"w{k}", F.lit(0.0)) for k in range(WIDTH))).alias("weights")
    cells = scratch.stored(held.select("gram", "block", "idf", "first", weights), "anchor-cells")
    return AnchorModel(cells, slots.select(block, place, "anchor", "label"), cells.count(), config)


def _cosines(texts: DataFrame, key: str, text: str, model: AnchorModel) -> DataFrame:
    """(key, block, cosines array<double> of WIDTH): a row for each text and block that share an n-gram."""
    # n-grams that a small model lacks are not summed up
    only = model.cells.where("first").select("gram") if model.rows <= BROADCAST_ROWS else None
    grams = counted_grams(texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key is not null"), "_key", "_text", model.config, only)
    # a small model goes to where the texts' counts are, and few texts to where a large model's blocks are, so that products are summed up there;
    # else both are met by n-gram, between two exchanges that adaptive execution can split
    cells = model.cells
    if model.rows <= BROADCAST_ROWS:
        cells = F.broadcast(cells)
    else:
        grams = scratch.stored(grams, "text-grams")
        few = grams.count() <= BROADCAST_COUNTS
        grams, cells = (F.broadcast(grams), cells) if few else (grams, cells.hint("merge"))
    q = (1 + F.log("n")) * F.col("idf")
    met = grams.join(cells, "gram").select("_key", "block", "first", q.alias("q"), "weights")
    dots = [F.sum(F.col("q") * F.get("weights", F.lit(k))).alias(f"s{k}") for k in range(WIDTH)]
    sums = met.groupBy("_key", "block").agg(F.sum(F.when(F.col("first"), F.col("q") * F.col("q"))).alias("squares"), *dots)
    normed = sums.withColumn("norm", F.sqrt(F.sum("squares").over(Window.partitionBy("_key"))))
    return normed.select("_key", "block", F.array(*(F.round(F.col(f"s{k}") / F.col("norm"), DECIMALS) for k in range(WIDTH))).alias("cosines"))


def _first(score: Column, *more: str) -> Column:
    """The struct that is least when ordered: highest score, then the columns named."""
    return F.struct((-score).alias("minus"), *more)


def label_scores(texts: DataFrame, model: AnchorModel, key: str = "ticket_id", text: str = "masked") -> DataFrame:
    """(key, label, score, anchor): the nearest anchor of each label that a text shares an n-gram with; of equal ones the first by name.

    Keys tell texts apart: rows that share a key are one text, in parts. Rows without a key are left out.
    """
    each = _cosines(texts, key, text, model).select("_key", "block", F.posexplode("cosines").alias("place", "score")).where("score > 0")
    met = each.join(model.places, ["block", "place"]).groupBy("_key", "label").agg(F.min(_first(F.col("score"), "anchor")).alias("best"))
    return met.select(F.col("_key").alias(key), "label", (-F.col("best.minus")).alias("score"), F.col("best.anchor").alias("anchor"))


def nearest_anchor(texts: DataFrame, model: AnchorModel, key: str = "ticket_id", text: str = "masked") -> DataFrame:
    """(key, label, score, anchor) of the nearest of all anchors, ties by label, then name; texts that are near to none have no row.

    Places of a block are in the order of label and name, so a block's best is found within its row and only that is looked up.
    """
    best = lambda c: let(F.array_max(c), lambda top: F.struct((-top).alias("minus"), (F.array_position(c, top) - 1).cast("int").alias("place")))
    each = _cosines(texts, key, text, model).select("_key", "block", let(F.col("cosines"), best).alias("b")).select("_key", "block", "b.place", "b.minus")
    best = each.join(model.places, ["block", "place"]).groupBy("_key").agg(F.min(F.struct("minus", "label", "anchor")).alias("best")).where("best.minus < 0")
    return best.select(F.col("_key").alias(key), "best.label", (-F.col("best.minus")).alias("score"), "best.anchor")
