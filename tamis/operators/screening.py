"""Evidence matrix, status, and the whole screening of tickets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis import fixed
from tamis.config import DEFAULT, Config
from tamis.functions.text import suffix
from tamis.operators import logs
from tamis.operators.blocks import parse_tickets
from tamis.operators.classify import infer
from tamis.operators.entities import anonymize, has_entity
from tamis.scratch import stored

EVIDENCE = "array<struct<item:string,satisfied:boolean>>"
#: (masked text, entities, bundle) -> boolean column
Predicate = Callable[[Column, Column, Column], Column]


def role(name: Column) -> Column:
    """log, visual or other, by the file's suffix."""
    s = suffix(name)
    return F.when(s.isin(*fixed.LOG_EXTENSIONS), "log").when(s.isin(*fixed.VISUAL_EXTENSIONS), "visual").otherwise("other")


def bundles(attachments: DataFrame) -> DataFrame:
    """(ticket_id, bundle struct<logs, visuals, others, total>) of (ticket_id, ord, name)."""
    of = lambda kind: F.count_if(F.col("role") == kind).alias(kind)
    counts = attachments.withColumn("role", role(F.col("name"))).groupBy("ticket_id").agg(of("log"), of("visual"), of("other"))
    return counts.select("ticket_id", F.struct(F.col("log").alias("logs"), F.col("visual").alias("visuals"), F.col("other").alias("others"), (F.col("log") + F.col("visual") + F.col("other")).alias("total")).alias("bundle"))


def has_time(text: Column, entities: Column, bundle: Column) -> Column:
    # one character's class, which every form of a time begins with, is cheaper to look at than its bound
    return text.rlike(rf"(?iuU)(?=[\daà])(?:{fixed.TIME_PATTERN})")


def has_phone(text: Column, entities: Column, bundle: Column) -> Column:
    return has_entity(entities, "TELEFONE", fixed.HIGH)


def has_artifact(text: Column, entities: Column, bundle: Column) -> Column:
    return (bundle["visuals"] + bundle["logs"] > 0) | text.rlike(rf"(?iuU)(?=[{''.join(sorted({w[0] for w in fixed.ARTIFACT_WORDS}))}])\b(?:{'|'.join(fixed.ARTIFACT_WORDS)})\b")


#: What each symptom demands, in order; more rules may be passed to ``evidence``.
RULES: dict[str, tuple[tuple[str, Predicate], ...]] = {
    fixed.AUDIO: ((fixed.ITEM_TIME, has_time), (fixed.ITEM_PHONE, has_phone)),
    fixed.UX: ((fixed.ITEM_ARTIFACT, has_artifact),),
    fixed.QUEUE: ((fixed.ITEM_TIME, has_time),),
}


def evidence(symptom: Column, text: Column, entities: Column, bundle: Column, rules: dict[str, tuple[tuple[str, Predicate], ...]] = RULES) -> Column:
    """array<struct<item, satisfied>>; symptoms without rules demand nothing."""
    out = F.when(F.lit(False), F.array().cast(EVIDENCE))
    for name, checks in rules.items():
        if checks:
            out = out.when(symptom == name, F.array(*(F.struct(F.lit(item).alias("item"), F.coalesce(check(text, entities, bundle), F.lit(False)).alias("satisfied")) for item, check in checks)))
    return F.coalesce(out, F.array().cast(EVIDENCE))


def missing(evidences: Column) -> Column:
    return F.transform(F.filter(evidences, lambda e: ~e["satisfied"]), lambda e: e["item"])


def status(symptom: Column, evidences: Column) -> Column:
    lacking = F.exists(evidences, lambda e: ~e["satisfied"])
    return F.when(lacking, fixed.BLOCKED).when(symptom.isin(fixed.UNKNOWN, fixed.TOO_SHORT), fixed.ATTENTION).otherwise(fixed.APPROVED)


def lookup(value: Column, table: dict[str, object]) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for k, v in table.items():
        out = out.when(value == k, F.lit(v))
    return out


def screen(tickets: DataFrame, attachments: DataFrame | None = None, log_lines: DataFrame | None = None, config: Config = DEFAULT, rules: dict[str, tuple[tuple[str, Predicate], ...]] = RULES, with_hits: bool = True) -> DataFrame:
    """One verdict a ticket.

    tickets (ticket_id, raw_text); attachments (ticket_id, ord, name); log_lines (ticket_id, att_ord, file_name,
    line_number, line). Tickets without log files have a null log_analysis; its hits are empty unless they are wanted.
    Rows that repeat a ticket_id get a verdict each, by their own text; attachments and logs belong to all of them.

    The masked tickets are read twice, by the classifier and by the rules, so they are written to the shared folder
    first. Without that the parser and detector would run twice, and filters pushed through them would copy their
    expressions many times over. ``scratch.sweep`` deletes the table once the verdicts are used.
    """
    masked = parse_tickets(tickets).withColumn("a", anonymize(F.col("analysis_text"))).select("ticket_id", "discarded_blocks", "a.masked", "a.entities")
    masked = stored(masked, "masked")
    out = infer(masked, "ticket_id", "masked", config)
    none = F.struct(*(F.lit(0).cast("bigint").alias(n) for n in ("logs", "visuals", "others", "total")))
    if attachments is None:
        out = out.withColumns({"bundle": none, "log_analysis": F.lit(None).cast("string")})
    else:
        bundle = bundles(attachments)
        out = out.join(bundle, "ticket_id", "left").withColumn("bundle", F.coalesce("bundle", none))
        if log_lines is not None:
            files = bundle.where("bundle.logs > 0").select("ticket_id", F.col("bundle.logs").alias("scanned_files"))
            out = out.join(logs.analyze(logs.find_hits(log_lines), files, config, with_hits), "ticket_id", "left")
    symptom = F.col("inference.symptom")
    out = out.withColumn("evidences", evidence(symptom, F.col("masked"), F.col("entities"), F.col("bundle"), rules)).withColumn("status", status(symptom, F.col("evidences")))
    if "log_analysis" in out.columns and dict(out.dtypes)["log_analysis"] != "string":
        matches = logs.matches_text(F.col("log_analysis.dominant_symptom"), symptom)
    else:
        out = out.drop("log_analysis").withColumn("log_analysis", F.lit(None).cast(f"struct<hits:{logs.HITS},counts_by_symptom:map<string,bigint>,dominant_symptom:string,total_hits:bigint,scanned_files:bigint,truncated:boolean>"))
        matches = F.lit(None).cast("boolean")
    return out.select(
        "ticket_id", "masked", symptom.alias("symptom"), F.col("inference.confidence").alias("confidence"), F.col("inference.runner_ups").alias("runner_ups"),
        "status", lookup(F.col("status"), fixed.EXIT_CODES).alias("exit_code"), lookup(F.col("status"), fixed.ACTIONS).alias("action"),
        "evidences", missing(F.col("evidences")).alias("missing"), "entities", "bundle", "log_analysis",
        matches.alias("matches_text"), F.coalesce(~matches, F.lit(False)).alias("has_divergence"), "discarded_blocks",
    )
