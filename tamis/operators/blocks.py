"""Block-structured ticket bodies: parsing, lookup, analysis text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis import fixed
from tamis.functions.text import let, normalize_header, split_lines, strip

FIELDS = "array<struct<key:string,value:string>>"
BLOCKS = f"array<struct<name:string,raw_header:string,fields:{FIELDS}>>"
PARSED = f"struct<blocks:{BLOCKS},is_structured:boolean>"


def is_header(line: Column) -> Column:
    return ~F.contains(line, F.lit("->")) & line.rlike("(?U)" + fixed.HEADER_LINE) & normalize_header(line).isin(*fixed.BLOCKS)


def parse(raw: Column) -> Column:
    """struct<blocks, is_structured> of a ticket body; null bodies have no blocks.

    Lines are typed and numbered first; each block is then the slice of lines from its header to the next, and each field
    the slice from its delimiter line to the next, cut by number: no state is carried from line to line, and none is looked at twice.
    """
    body = F.replace(F.ltrim(F.coalesce(raw, F.lit("")), F.lit("\ufeff")), F.lit("\u00a0"), F.lit(" "))
    lines = F.transform(
        split_lines(body),
        lambda x, i: F.struct(i.alias("i"), x.alias("line"), is_header(x).alias("header"), F.contains(x, F.lit("->")).alias("field"), strip(x).alias("text")),
    )

    def fields_of(inner: Column, starts: Column) -> Column:
        head = F.get(inner, F.lit(0))["i"]

        def one(s: Column, k: Column) -> Column:
            to = F.coalesce(F.get(starts, k + 1)["i"], head + F.size(inner))
            more = F.transform(F.slice(inner, s["i"] - head + 2, to - s["i"] - 1), lambda x: x["text"])
            halves = F.split(s["line"], "(?U)" + fixed.FIELD_DELIMITER, 2)
            value = F.array_join(F.filter(F.concat(F.array(strip(F.get(halves, F.lit(1)))), more), lambda v: v != ""), " ")
            return F.struct(strip(F.get(halves, F.lit(0))).alias("key"), value.alias("value"))

        return F.transform(starts, one)

    def blocks_of(all_: Column, heads: Column) -> Column:
        def one(h: Column, k: Column) -> Column:
            to = F.coalesce(F.get(heads, k + 1)["i"], F.size(all_))
            fields = let(F.slice(all_, h["i"] + 2, to - h["i"] - 1), lambda inner: let(F.filter(inner, lambda x: x["field"]), lambda starts: fields_of(inner, starts)))
            return F.struct(normalize_header(h["line"]).alias("name"), h["text"].alias("raw_header"), fields.alias("fields"))

        return F.struct(F.transform(heads, one).alias("blocks"), (F.size(heads) > 0).alias("is_structured")).cast(PARSED)

    return let(lines, lambda all_: let(F.filter(all_, lambda x: x["header"]), lambda heads: blocks_of(all_, heads)))


def block(parsed: Column, name: str) -> Column:
    """First block of that name, or null."""
    return F.get(F.filter(parsed["blocks"], lambda b: b["name"] == name), F.lit(0))


def field(block_: Column, key: str) -> Column:
    """Value of the first field with that key, trimmed and in any case, or null."""
    return F.get(F.filter(block_["fields"], lambda f: F.lower(strip(f["key"])) == key.strip().lower()), F.lit(0))["value"]


def values_text(block_: Column) -> Column:
    return F.array_join(F.filter(F.transform(block_["fields"], lambda f: f["value"]), lambda v: v != ""), "\n")


def narrative(parsed: Column) -> Column:
    details = block(parsed, fixed.ANALYSIS_BLOCK)
    return F.coalesce(field(details, fixed.NARRATIVE_FIELD), values_text(details), F.lit(""))


def analysis_text(raw: Column, parsed: Column) -> Column:
    """The narrative, even if blank; else the details' values; else the whole body as it came."""
    def chosen(details: Column) -> Column:
        values = let(strip(values_text(details)), lambda v: F.when(v != "", v).otherwise(strip(F.coalesce(raw, F.lit("")))))
        return F.coalesce(strip(field(details, fixed.NARRATIVE_FIELD)), values, strip(F.coalesce(raw, F.lit(""))))

    return let(block(parsed, fixed.ANALYSIS_BLOCK), chosen)


def discarded_blocks(parsed: Column) -> Column:
    return F.filter(F.transform(parsed["blocks"], lambda b: b["name"]), lambda n: n != fixed.ANALYSIS_BLOCK)


def as_map(parsed: Column) -> Column:
    """{block: {key: value}}; of repeated names and keys the last holds. Fields of repeated blocks don't mix."""

    def last(entries: Column) -> Column:
        """The last entry of each key, in the order of those entries: of neighbours by key and place, the one before another key."""
        placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"], i.alias("i"))))
        ends = let(placed, lambda p: F.array_sort(F.transform(F.filter(p, lambda x, k: ~F.coalesce(F.get(p, k + 1)["key"] == x["key"], F.lit(False))), lambda x: x["i"])))
        return F.transform(ends, lambda i: F.get(entries, i))

    inner = F.transform(parsed["blocks"], lambda b: F.struct(b["name"].alias("key"), F.map_from_entries(last(b["fields"])).alias("value")))
    return let(inner, lambda entries: F.map_from_entries(last(entries)))


def parse_tickets(tickets: DataFrame) -> DataFrame:
    """(ticket_id, raw_text) with parsed, analysis_text, discarded_blocks."""
    raw = F.col("raw_text")
    read = let(raw, lambda r: let(parse(r), lambda p: F.struct(p.alias("parsed"), analysis_text(r, p).alias("analysis_text"), discarded_blocks(p).alias("discarded_blocks"))))
    return tickets.withColumn("_read", read).select(*tickets.columns, "_read.*")
