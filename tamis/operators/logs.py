"""Log forensics: signatures, counts, retained hits, dominant cause."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis import fixed
from tamis.config import DEFAULT, Config
from tamis.functions.text import let, strip
from tamis.operators.entities import mask_sensitive_data

SYMPTOMS = tuple(sorted({s for s, _, _ in fixed.SIGNATURES}))
#: Lines of a file whose hits are put in order together; a ticket's blocks are so many tasks' work.
BLOCK_LINES = 1 << 14
ANY_SIGNATURE = "(?iuU)" + "|".join(f"(?:{p})" for _, _, p in fixed.SIGNATURES)
#: Of these every signature holds one, in lower case.
LITERALS = ("http", "internal server error", "uncaught ", "heap out of memory", "jitter", "packet loss", "sip/4", "acd_queue", "agent_state", "routing_engine")
HITS = "array<struct<file_name:string,line_number:bigint,symptom:string,label:string,excerpt:string>>"


def match(line: Column) -> Column:
    """struct<symptom, label> of the leftmost signature, earlier ones first at the same place; null where none fits."""
    places = [F.struct(F.regexp_instr(line, F.lit(f"(?iuU){p}")).alias("at"), F.lit(i).alias("i")) for i, (_, _, p) in enumerate(fixed.SIGNATURES)]
    first = F.array_min(F.filter(F.array(*places), lambda x: x["at"] > 0))["i"]
    table = F.array(*(F.struct(F.lit(s).alias("symptom"), F.lit(label).alias("label")) for s, label, _ in fixed.SIGNATURES))
    return F.get(table, first)


def has_signature(line: Column) -> Column:
    """Whether any signature fits. Literals are looked for first in ASCII lines; in others some letters have more than two forms.

    The line is bound once, as a filter is pushed down to where lines are made, and its expression put in place of each mention.
    """

    def fits(x: Column) -> Column:
        likely = let(F.lower(x), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(s)) for s in LITERALS)))
        return ((F.octet_length(x) != F.length(x)) | likely) & x.rlike(ANY_SIGNATURE)

    return let(line, fits)


def find_hits(lines: DataFrame) -> DataFrame:
    """The lines (ticket_id, att_ord, file_name, line_number, line) with a signature, and its symptom and label."""
    hits = lines.where(has_signature(F.col("line"))).withColumn("m", match(F.col("line")))
    return hits.select(*lines.columns, "m.symptom", "m.label")


def _cut(line: Column, config: Config) -> Column:
    return F.substring(strip(line), 1, config.log_excerpt_max_chars)


def excerpt(line: Column, config: Config = DEFAULT) -> Column:
    """The line cut to its first characters, then masked."""
    return mask_sensitive_data(_cut(line, config))


def retain(hits: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The first hits of each ticket, in the order of attachments and lines."""
    order = Window.partitionBy("ticket_id").orderBy("att_ord", "line_number")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.log_max_hits)


def _counts() -> list[Column]:
    return [F.count_if(F.col("symptom") == s).alias(s) for s in SYMPTOMS]


def _told(config: Config) -> list[Column]:
    """What the counts of a ticket's symptoms say: all hits, counts by symptom, and the most frequent, of equal ones the first by name."""
    pairs = F.array_sort(F.filter(F.array(*(F.struct((-F.col(s)).alias("minus"), F.lit(s).alias("symptom")) for s in SYMPTOMS)), lambda c: c["minus"] < 0))
    top = F.get(pairs, F.lit(0))
    return [
        sum((F.col(s) for s in SYMPTOMS[1:]), F.col(SYMPTOMS[0])).alias("total_hits"),
        F.map_from_entries(F.transform(pairs, lambda c: F.struct(c["symptom"], -c["minus"]))).alias("counts_by_symptom"),
        F.when(-top["minus"] >= config.log_dominance_min_hits, top["symptom"]).alias("dominant_symptom"),
    ]


def tally(hits: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(ticket_id, total_hits, counts_by_symptom, dominant_symptom) of tickets with a hit.

    One aggregation: tasks sum up their lines first, so one exchange of a row a ticket and task, however long its logs are.
    """
    return hits.groupBy("ticket_id").agg(*_counts()).select("ticket_id", *_told(config))


def partials(hits: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(ticket_id, a count for each of SYMPTOMS, first array<struct<att_ord, line_number, ...>>): what summaries are made of, and can be ``merged``.

    Counts and hits go together, so lines are read once. Hits are first brought together by block of lines, which keeps
    its counts and its first hits; a ticket with most lines is many blocks. A ticket's blocks are then walked in order,
    and only those that begin before the cap is reached hand on their hits: as many blocks as the cap at most.
    """
    cap = config.log_max_hits
    rows = hits.select("ticket_id", "att_ord", "symptom", F.floor(F.col("line_number") / F.lit(BLOCK_LINES)).alias("block"), F.struct("att_ord", "line_number", "file_name", "symptom", "label", _cut(F.col("line"), config).alias("text")).alias("hit"))
    blocks = rows.groupBy("ticket_id", "att_ord", "block").agg(*_counts(), F.slice(F.array_sort(F.collect_list("hit")), 1, cap).alias("hits"))
    total = sum((F.col(s) for s in SYMPTOMS[1:]), F.col(SYMPTOMS[0]))
    earlier = Window.partitionBy("ticket_id").orderBy("att_ord", "block").rowsBetween(Window.unboundedPreceding, -1)
    walked = blocks.withColumn("earlier", F.coalesce(F.sum(total).over(earlier), F.lit(0)))
    return merged(walked.withColumn("first", F.when(F.col("earlier") < cap, F.col("hits"))), config)


def merged(parts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row a ticket of rows like those of ``partials``: counts added up, and of all first hits the first."""
    first = F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, config.log_max_hits)
    return parts.groupBy("ticket_id").agg(*(F.sum(s).alias(s) for s in SYMPTOMS), first.alias("first"))


def shown(tickets: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(ticket_id, total_hits, counts_by_symptom, dominant_symptom, hits with masked excerpts) of merged rows."""
    hits = F.transform("first", lambda h: F.struct(h["file_name"], h["line_number"], h["symptom"], h["label"], mask_sensitive_data(h["text"]).alias("excerpt"))).cast(HITS)
    return tickets.select("ticket_id", *_told(config), hits.alias("hits"))


def summarize(hits: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The tally with the first hits of each ticket, by attachment and line, their excerpts masked."""
    return shown(partials(hits, config), config)


def analyze(hits: DataFrame, files: DataFrame, config: Config = DEFAULT, with_hits: bool = True) -> DataFrame:
    """One row for every ticket with log files: counts, dominant cause and, if wanted, retained hits.

    files: (ticket_id, scanned_files). Counts cover all hits, retained or not.
    """
    found = summarize(hits, config) if with_hits else tally(hits, config).withColumn("hits", F.array().cast(HITS))
    out = files.join(found, "ticket_id", "left")
    total = F.coalesce("total_hits", F.lit(0))
    return out.select(
        "ticket_id",
        F.struct(
            F.coalesce("hits", F.array().cast(HITS)).alias("hits"),
            F.coalesce("counts_by_symptom", F.create_map().cast("map<string,bigint>")).alias("counts_by_symptom"),
            F.col("dominant_symptom"),
            total.alias("total_hits"),
            F.col("scanned_files"),
            (total > config.log_max_hits).alias("truncated"),
        ).alias("log_analysis"),
    )


def matches_text(dominant: Column, symptom: Column) -> Column:
    """Whether the log's cause is the text's symptom; null where either is open."""
    return F.when(dominant.isNotNull() & ~symptom.isin(fixed.UNKNOWN, fixed.TOO_SHORT), dominant == symptom)
