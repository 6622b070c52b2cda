"""Mixing sources to target weights by a time-varying curriculum.

A source has a weight and a schedule: its rate at training time t in [0, 1] is linear from ``start`` to
``end`` times its mean. Integrating the rate gives the share of its tokens demanded by t; inverting that
integral at a document's cumulative share of the source's tokens gives the document's training position,
and range-sorting by position gives the training order.

Targets: sources by code point with null last weigh 5, 2, 1, repeating, and share 150 % of all sizes. A
target stops at ``max_epochs`` times its source's size; the excess is shared again by weight among the
others until none is above. Whole copies are taken: a target of r times the source's size gives every
document floor(r) copies and one more to those in the first r - floor(r) of the source's tokens, in the
order of a hash of the identifier. Running sums are taken in levels (spans of hash ranges, ranges, then rows
within a range) so that no task holds a source, however large. Target arithmetic runs on one row per source, in
running sums over parts of the sources' order, so that no task holds all sources.

Null text has size 0; documents of size 0 are returned with nothing taken and no position; a null source is
a source of its own, last; a repeated doc_id counts as rows of the same hash, ordered by source and size.
Empty tables give no rows. Extra columns are ignored. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.llm.common import stored, table, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
#: Rate at the start of training over the mean rate, by the same turns as the weights: the first kind of
#: source fades in, the second is even, the third fades out. The rate at the end is 2 minus it.
STARTS = (0.5, 1.0, 1.5)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2.0
RANGE_ROWS = 4096
SPAN_RANGES = 4096
SPOT_BITS = 60
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; the runs of other characters are cut first, which costs less than listing words."""
    packed = F.regexp_replace(text, WORD, "x")
    return F.length(F.translate(packed, " \t\n\u000b\f\r", "")).cast("bigint")


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with sums over all rows up to each in the order, which must have no ties: by parts of the order, then within a part."""
    placed = rows.select("*", *(c.alias(f"own_{name}") for name, c in sums.items())).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    placed = stored(placed, "mix-ordered")
    parts = placed.groupBy("part").agg(*(F.sum(f"own_{name}").alias(name) for name in sums))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = parts.select("part", *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"before_{name}") for name in sums))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(F.broadcast(parts), "part")
    return out.select(*rows.columns, *((F.col(f"before_{name}") + F.sum(f"own_{name}").over(within)).alias(name) for name in sums))


def targets(sizes: DataFrame, weights=WEIGHTS, starts=STARTS, total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> also target, start. Water-filling in closed form.

    A source is full exactly if its cap over its weight is below the common level; in the order of
    cap / weight, the level after the first k are full is (total - their caps) / (weight of the rest).
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    kind = ((F.col("turn") - 1) % len(weights)).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), kind + 1)
    start = F.element_at(F.array(*map(F.lit, starts)), kind + 1)
    rows = running(sizes.select("source", "source_size"), by_name, turn=F.lit(1).cast("bigint"))
    rows = stored(rows.select("source", "source_size", weight.alias("weight"), start.alias("start"), (F.lit(max_epochs) * F.col("source_size")).alias("cap")), "mix-sources")
    all_size, all_weights = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    total = total_share * (all_size or 0)
    rows = running(rows, [F.col("cap") / F.col("weight"), *by_name], caps=F.col("cap"), weights=F.col("weight"))
    # the level if the sources before it are full, without it; it is full if its own cap is below that
    level = (F.lit(total) - (F.col("caps") - F.col("cap"))) / (F.lit(all_weights) - (F.col("weights") - F.col("weight")))
    rows = stored(rows.select("*", level.alias("level")).select("*", (F.col("cap") / F.col("weight") <= F.col("level")).alias("full")), "mix-levels")
    left = rows.where("not full").agg(F.min(F.struct("caps", "level"))["level"]).first()[0]
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.lit(left).cast("double") * F.col("weight")).alias("target"), "start")


def inverse_demand(share: Column, start: Column) -> Column:
    """t at which a rate going linearly from start to 2 - start has given ``share`` of its tokens: start t + (1 - start) t^2 = share."""
    # the stable form of the root; for start = 1 it is the share itself
    root = F.sqrt(F.greatest(F.lit(0.0), start * start + 4 * (1 - start) * share))
    return F.least(F.lit(1.0), F.when(start + root == 0, F.lit(0.0)).otherwise(2 * share / (start + root)))


def spot() -> Column:
    """A document's place in its source's order: the first SPOT_BITS of the digest of its identifier, which other engines have too."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, SPOT_BITS // 4), 16, 10).cast("bigint")


def curriculum(docs: DataFrame, **kinds) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken, positions (one for each copy)."""
    rows = stored(docs.select("doc_id", "source", n_words(text_or_empty()).alias("size")).withColumn("spot", spot()), "mix-sizes")
    bits = SPOT_BITS - F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.col("n"), F.lit(1)) / RANGE_ROWS)) + 1).cast("int")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = targets(by_source.select("source", "source_size"), **kinds).join(by_source.select(F.col("source").alias("s"), bits.alias("bits")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = stored(plan.coalesce(1), "mix-plan")

    rows = rows.withColumnRenamed("source", "s").join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ranged = rows.withColumn("range", F.expr("shiftright(spot, bits)"))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    # a source has a range for RANGE_ROWS / 2 documents or more, and a span for SPAN_RANGES ranges
    sums = stored(sums.withColumn("span", F.floor(F.col("range") / SPAN_RANGES)), "mix-ranges")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    spans = sums.groupBy("source", "span").agg(F.sum("words").alias("words"))
    spans = spans.select(F.col("source").alias("s"), F.col("span").alias("p"), F.coalesce(F.sum("words").over(earlier.partitionBy("source").orderBy("span")), F.lit(0)).alias("below"))
    sums = sums.withColumn("here", F.coalesce(F.sum("words").over(earlier.partitionBy("source", "span").orderBy("range")), F.lit(0)))
    sums = sums.join(spans, F.col("source").eqNullSafe(F.col("s")) & (F.col("span") == F.col("p"))).select(F.col("source").alias("s"), F.col("range").alias("r"), (F.col("below") + F.col("here")).alias("before"))
    within = Window.partitionBy("source", "range").orderBy("spot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("upto", F.sum("size").over(within)).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    upto, size, whole = F.col("before") + F.col("upto"), F.col("size"), F.col("source_size")
    epochs = F.col("target") / F.nullif(whole, F.lit(0))
    full = F.floor(epochs).cast("int")
    # one more copy where the middle of the document lies in the part of the source that is repeated
    more = ((upto - size / 2) <= (epochs - full) * whole).cast("int")
    copies = F.when(size > 0, F.coalesce(full + more, F.lit(0))).otherwise(0).cast("int")
    placed = placed.select("doc_id", "source", "size", "source_size", "target", "start", upto.alias("upto"), copies.alias("copies"))
    # a copy's share of what its source gives: the k-th pass over the source starts at k times its size
    share = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: F.least(F.lit(1.0), (k * whole + F.col("upto") - size / 2) / F.greatest(F.col("target"), F.lit(1.0))))
    positions = F.when(F.col("copies") > 0, F.transform(share, lambda x: inverse_demand(x, F.col("start")))).otherwise(F.array().cast("array<double>"))
    return placed.select("doc_id", "source", "size", "source_size", "target", "copies", (size * F.col("copies")).alias("taken"), positions.alias("positions"))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row a copy, range-sorted by training position."""
    copies = mixed.select("*", F.posexplode("positions").alias("epoch", "position")).drop("positions")
    return copies.sort("position", "doc_id", "epoch")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum(table(spark, sf_dir, "documents"))
    first = F.get("positions", F.lit(0))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", first.alias("position")).sort(F.col("position").asc_nulls_last(), "doc_id")


SQL = r"""
with d as materialized (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as spot from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
k as (select *, (row_number() over (order by source is null, source) - 1) % 3 as kind from s),
w as (select *, cast([5, 2, 1][kind + 1] as double) as weight, cast([0.5, 1, 1.5][kind + 1] as double) as start, cast(2 * source_size as double) as cap from k),
sums as (select *, sum(cap) over o as caps, sum(weight) over o as weights, sum(weight) over () as all_weights, cast(1.5 as double) * sum(source_size) over () as total
         from w window o as (order by cap / weight, source is null, source rows unbounded preceding)),
levels as (select *, (total - (caps - cap)) / (all_weights - (weights - weight)) as level from sums),
plan as (select source, source_size, start, case when cap / weight <= level then cap else weight * (select arg_min(level, caps) from levels where cap / weight > level) end as target from levels),
placed as (select doc_id, size, source_size, target, start, target / nullif(source_size, 0) as epochs, sum(size) over (partition by d.source order by spot, doc_id nulls first, size rows unbounded preceding) - cast(size as double) / 2 as middle
           from d join plan on d.source is not distinct from plan.source),
counted as (select *, case when size > 0 then cast(floor(epochs) as integer) + cast(middle <= (epochs - floor(epochs)) * source_size as integer) else 0 end as copies from placed),
shares as (select *, least(cast(1 as double), middle / greatest(target, cast(1 as double))) as share from counted)
select doc_id, size, source_size, target, cast(size * copies as bigint) as taken, copies,
       case when copies > 0 then least(cast(1 as double), 2 * share / (start + sqrt(greatest(cast(0 as double), start * start + 4 * (1 - start) * share)))) end as position
from shares
"""
