"""Text functions as column expressions, with Unicode semantics."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line breaks of a ticket body.
LINE_BREAKS = "\r\n|[\n\u000b\f\r\u001c-\u001e\u0085  ]"
#: The same but the pair, each one character.
_BREAKS = "\r\u000b\f\u001c\u001d\u001e\u0085\u2028\u2029"
#: White space of all Unicode kinds, and the separators that Python counts as such.
SPACES = "\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Line breaks of a log file.
LOG_LINE_BREAKS = "\r\n|\r|\n"


def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters below U+2000 whose compatibility decomposition without marks is one other character, those characters, and the longer ones."""
    one, to, more = [], [], {}
    for i in range(0x80, 0x2000):
        c = chr(i)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c or unicodedata.combining(c):
            continue
        if len(plain) == 1:
            one.append(c)
            to.append(plain)
        elif i < 0x250:
            more[c] = plain
    return "".join(one), "".join(to), more


FOLD_FROM, FOLD_TO, FOLD_MORE = _folds()
#: All characters that fold to several.
FOLD_LONG = {**FOLD_MORE, "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends, of all Unicode kinds."""
    return F.btrim(text, F.lit(SPACES))


def fold_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks; characters that fold to several are those below U+0250."""
    rare = "[" + "".join(FOLD_MORE) + "ﬀ-ﬆ]"
    several = text
    for c, plain in FOLD_LONG.items():
        several = F.replace(several, F.lit(c), F.lit(plain))
    text = F.when(text.rlike(rare), several).otherwise(text)
    return F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), r"\p{Mn}+", "")


def normalize_header(text: Column) -> Column:
    """Unaccented, lower case, single spaces, without colons at the end."""
    spaced = strip(F.regexp_replace(fold_accents(text), r"(?U)\s+", " "))
    return strip(F.regexp_replace(F.lower(spaced), ":+$", ""))


def split_lines(text: Column) -> Column:
    """Lines of a ticket body; a break at the very end opens no line. Breaks become one kind first, as a single character is found without a pattern."""
    even = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    for c in _BREAKS:
        even = F.replace(even, F.lit(c), F.lit("\n"))
    return let(F.split(even, "\n", -1), lambda lines: F.when((F.size(lines) > 1) & (F.element_at(lines, -1) == ""), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines))


def suffix(name: Column) -> Column:
    """Lower-case suffix with its dot; dot files and names that end in a dot have none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"^.+(\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    last = F.element_at(F.split(name, "/"), -1)
    return F.regexp_replace(last, r"^(.+)\.[^.]+$", "$1")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D", "")


#: Parts that ``marked_spans`` takes at a time; even, so that every block begins outside a match.
BLOCK = 64
SPANS = "array<struct<start:int,end:int,raw:string>>"


def marked_spans(parts: Column) -> Column:
    """array<struct<start, end, raw>> of every second of the parts that a text was split into around its matches, offsets in code points.

    Arrays grow by copying, so offsets are summed by blocks of parts first and then within each block: a text of n
    matches costs n * BLOCK / 2 + (n / BLOCK)^2 / 2 steps in place of n^2 / 2.
    """
    none = F.array().cast(SPANS)

    def found(p: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / F.lit(BLOCK)).cast("int"))
        block = lambda b: F.slice(p, b * BLOCK + 1, F.lit(BLOCK))
        sizes = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda acc, x: acc + F.length(x)))
        heads = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))

        def step(acc: Column, x: Column) -> Column:
            end = acc["pos"] + F.length(x)
            span = F.struct(acc["pos"].alias("start"), end.alias("end"), x.alias("raw"))
            return F.struct(end.alias("pos"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

        def within(b: Column, head: Column) -> Column:
            return F.aggregate(block(b), F.struct(head.alias("pos"), F.lit(False).alias("inside"), none.alias("found")), step, lambda acc: acc["found"])

        return let(heads, lambda h: F.flatten(F.transform(blocks, lambda b: within(b, F.get(h, b)))))

    def single(p: Column) -> Column:
        head, raw = F.length(F.get(p, F.lit(0))), F.get(p, F.lit(1))
        return F.array(F.struct(head.alias("start"), (head + F.length(raw)).alias("end"), raw.alias("raw"))).cast(SPANS)

    return let(parts, lambda p: F.when(F.size(p) == 3, single(p)).when(F.size(p) > 1, found(p)).otherwise(none))
