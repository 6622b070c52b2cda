"""Typed, confidence-scored spans of sensitive text; overlap resolution and masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis import fixed
from tamis.functions.text import digits, let, marked_spans

#: Sentinel around matches while spans are located; in the text itself it becomes OTHER, which is as long and as inert.
MARK, OTHER = "\u0001", "\u0002"
FOUND = "array<struct<start:int,end:int,kind:string,confidence:string,raw:string>>"
ENTITIES = "array<struct<kind:string,start:int,end:int,raw:string,confidence:string>>"


def is_brazilian_phone(raw: Column) -> Column:
    def shaped(d: Column) -> Column:
        mobile = (F.length(d) == 11) & (F.substring(d, 3, 1) == "9")
        landline = (F.length(d) == 10) & F.substring(d, 3, 1).isin("2", "3", "4", "5")
        return F.substring(d, 1, 2).isin(*fixed.AREA_CODES) & (mobile | landline)

    return let(digits(raw), shaped)


def _parts(text: Column, rule: tuple) -> Column:
    """The text split around the rule's matches, which are every second part."""
    _, _, _, before, body, after, any_case, _ = rule
    first = f"(?=[{STARTS[rule[0]]}])" if rule[0] in STARTS else ""
    pattern = f"{'(?iuU)' if any_case else '(?U)'}{first}({before})({body}){after}"
    return F.split(F.regexp_replace(text, pattern, f"$1{MARK}$2{MARK}"), MARK, -1)


def _labelled(rule: tuple, parts: Column) -> Column:
    _, kind, confidence, *_, check = rule
    return F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(check).cast("string").alias("check"), parts.alias("parts"))


def detect(text: Column) -> Column:
    """array<struct<kind, start, end, raw, confidence>> by start; offsets are code points, end exclusive. Null text has none."""
    return let(text, _detect)


#: What the bones of a text must hold for a rule, by priority, to match at all: digits and what may stand between them.
NEEDS = {
    11: r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}", 12: r"\d{3}\.\d{3}\.\d{3}-\d{2}", 13: r"\dx\d{2}", 14: r"\d\.\d{1,3}\.\d{1,3}\.\d",
    20: r"\d{6}", 21: r"\d{11}|\d{3}\.\d{3}\.\d{3}-\d{2}", 22: r"\d{4}[\s-]?\d{4}", 23: r"\d{3}[-.]?\d",
    30: r"\d{2}\)\s*9?\d{4}", 31: r"\d{2}\s+9?\d{4}[-\s]\d{4}", 32: r"\d{4}-\d{4}", 40: r"\d{6}",
    50: r"\d{10}", 51: r"\d{11}", 52: r"\d{14}",
}


#: What a match of a rule, by priority, begins with: one character's class tells most places apart before words and bounds are looked at.
STARTS = {
    11: r"\d", 12: r"\d", 14: r"\d", 20: "pcrtion", 21: "cd", 22: "tfcrwz", 23: "ac", 30: "+(", 31: r"+\d", 32: r"\d", 40: "p", 50: r"\d", 51: r"\d", 52: r"\d",
}


def bones(text: Column) -> Column:
    """Stretches that begin with a digit, of digits, marks and white space, with an x between them; empty without digits. Cheap to look through sixteen times."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"(?U)\d[\d\s.()/-]*"), F.lit(0)), "x")


#: Pairs of spans that are held against each other one by one.
FEW = 64


def without_overlaps(taken: Column, more: Column) -> Column:
    """taken and those spans of more that overlap none of them; both are disjoint and by start, as is what is returned.

    The starts of both are sorted together: the place of a span of more among them, less its place in more, is the number
    of spans of taken that begin no later. So its neighbours in taken are looked up by number, with no search for each span.
    """
    starts = F.array_sort(F.concat(F.transform(taken, lambda a: a["start"].cast("bigint") * 2), F.transform(more, lambda b: b["start"].cast("bigint") * 2 + 1)))
    places = F.filter(F.transform(starts, lambda x, i: F.when(x % 2 == 1, i)), lambda i: i.isNotNull())

    def free(before: Column) -> Column:
        def apart(b: Column, j: Column) -> Column:
            n = F.get(before, j) - j
            return F.coalesce(F.get(taken, n - 1)["end"] <= b["start"], F.lit(True)) & F.coalesce(F.get(taken, n)["start"] >= b["end"], F.lit(True))

        return F.filter(more, apart)

    def few() -> Column:
        apart = F.filter(more, lambda b: ~F.exists(taken, lambda a: (a["start"] < b["end"]) & (b["start"] < a["end"])))
        return let(apart, lambda new: F.when(F.size(new) == 0, taken).otherwise(F.array_sort(F.concat(taken, new)))).cast(FOUND)

    merged = F.array_sort(F.concat(taken, let(places, free))).cast(FOUND)
    return F.when(F.size(more) == 0, taken).when(F.size(taken) == 0, more).when(F.size(taken) * F.size(more) <= FEW, few()).otherwise(merged)


def _detect(text: Column) -> Column:
    none, empty, nothing = F.array().cast(ENTITIES), F.array().cast(FOUND), F.array().cast("array<string>")

    def found(inert: Column, bare: Column) -> Column:
        at = F.contains(inert, F.lit("@"))

        def one(rule: tuple) -> Column:
            wanted = at if rule[1] == "EMAIL" else bare.rlike("(?U)" + NEEDS[rule[0]])
            if rule[1] == "VALOR":
                wanted = wanted & F.contains(inert, F.lit("$"))
            return _labelled(rule, F.when(wanted, _parts(inert, rule)).otherwise(nothing))

        def spans(rule: Column) -> Column:
            holds = lambda s: F.when(rule["check"].isNull(), True).otherwise(is_brazilian_phone(s["raw"]) == (rule["check"] == "phone"))
            of = F.filter(marked_spans(rule["parts"]), lambda s: (s["raw"] != "") & holds(s))
            return F.transform(of, lambda s: F.struct(s["start"], s["end"], rule["kind"], rule["confidence"], s["raw"])).cast(FOUND)

        # one expression finds the places of all rules' matches; earlier rules take theirs first
        matched = F.filter(F.array(*map(one, fixed.ENTITY_RULES)), lambda r: F.size(r["parts"]) > 1)
        by_start = F.aggregate(F.transform(matched, spans), empty, without_overlaps)
        kept = F.transform(by_start, lambda c: F.struct(c["kind"], c["start"], c["end"], c["raw"], c["confidence"])).cast(ENTITIES)
        return F.when((bare != "") | at, kept).otherwise(none)

    found_in = let(F.replace(text, F.lit(MARK), F.lit(OTHER)), lambda inert: let(bones(inert), lambda bare: found(inert, bare)))
    return F.coalesce(found_in, none)


#: Characters of the pieces that a text is cut into, so that a part of it is found without counting from its start.
CHUNK = 512


def _between(chunks: Column, start: Column, end: Column) -> Column:
    """The text from start to end; nothing where end is not beyond start."""
    first = F.floor(start / F.lit(CHUNK)).cast("int")
    many = F.when(end > start, F.floor((end - 1) / F.lit(CHUNK)).cast("int") - first + 1).otherwise(0)

    def part(chunk: Column, i: Column) -> Column:
        skip = F.when(i == 0, start - first * CHUNK).otherwise(0)
        return F.substring(chunk, skip + 1, F.least(end - (first + i) * CHUNK, F.lit(CHUNK)) - skip)

    return F.array_join(F.transform(F.slice(chunks, first + 1, many), part), "")


def mask(text: Column, entities: Column) -> Column:
    """text with the personal spans replaced by their tokens; protocol numbers, registrations and addresses stay. Linear in text and spans."""
    tokens = F.create_map(*(F.lit(x) for pair in fixed.MASKS.items() for x in pair))
    hidden = F.array_sort(F.transform(F.filter(entities, lambda e: ~e["kind"].isin(*fixed.VISIBLE_KINDS)), lambda e: F.struct(e["start"], e["end"], e["kind"])))

    def masked(t: Column, spans: Column, chunks: Column) -> Column:
        pieces = F.transform(spans, lambda e, i: F.concat(_between(chunks, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), e["start"]), tokens[e["kind"]]))
        return F.concat(F.array_join(pieces, ""), _between(chunks, F.element_at(spans, -1)["end"], F.length(t)))

    def joined(t: Column, spans: Column) -> Column:
        piece = lambda e, i: F.concat(let(F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), lambda s: F.substring(t, s + 1, e["start"] - s)), tokens[e["kind"]])
        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(t, F.element_at(spans, -1)["end"] + 1, F.length(t)))

    def cut(t: Column, spans: Column) -> Column:
        return F.when(F.octet_length(t) <= CHUNK, joined(t, spans)).otherwise(chunked(t, spans))

    def chunked(t: Column, spans: Column) -> Column:
        return let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), lambda chunks: masked(t, spans, chunks))

    return let(text, lambda t: let(hidden, lambda spans: F.when(F.size(spans) > 0, cut(t, spans)).otherwise(t)))


def anonymize(text: Column) -> Column:
    """struct<masked, entities>."""
    return let(text, lambda t: let(_detect(t), lambda found: F.struct(mask(t, found).alias("masked"), found.alias("entities"))))


def mask_sensitive_data(text: Column) -> Column:
    return anonymize(text)["masked"]


def has_entity(entities: Column, kind: str | Column, least: str | Column = fixed.MEDIUM) -> Column:
    return F.exists(entities, lambda e: (e["kind"] == kind) & ((F.lit(least) == fixed.MEDIUM) | (e["confidence"] == fixed.HIGH)))


def entity_counts(entities: Column) -> Column:
    """map kind -> count, kinds in the order they are first seen."""
    kinds = F.transform(entities, lambda e: e["kind"])
    return let(kinds, lambda all_: let(F.array_distinct(all_), lambda some: F.map_from_arrays(some, F.transform(some, lambda k: F.size(F.filter(all_, lambda x: x == k))))))
