"""Output of screenings: JSON documents, text reports, problem documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis import fixed
from tamis.config import DEFAULT, Config
from tamis.operators.entities import entity_counts
from tamis.operators.screening import RULES, lookup

KEEP_NULLS = {"ignoreNullFields": "false"}


def document() -> Column:
    """The screening of a row of ``screening.screen`` as a struct; entities appear as counts only."""
    log = F.col("log_analysis")
    details = F.transform(log["hits"], lambda h: F.struct(h["file_name"].alias("arquivo"), h["line_number"].alias("linha"), h["label"].alias("tipo"), h["symptom"].alias("sintoma"), h["excerpt"].alias("trecho")))
    analysis = F.struct(
        log["scanned_files"].alias("arquivos_lidos"), log["total_hits"].alias("ocorrencias"), log["truncated"].alias("truncado"), log["dominant_symptom"].alias("causa_dominante"),
        F.col("matches_text").alias("confere_com_texto"), log["counts_by_symptom"].alias("contagem_por_sintoma"), details.alias("ocorrencias_detalhadas"),
    )
    return F.struct(
        F.col("ticket_id").alias("chamado"),
        F.col("status"),
        F.col("action").alias("acao_necessaria"),
        F.struct(F.col("symptom").alias("codigo"), lookup(F.col("symptom"), fixed.SYMPTOM_LABELS).alias("descricao")).alias("sintoma"),
        F.col("confidence").alias("confianca"),
        F.transform("runner_ups", lambda r: F.struct(r["symptom"].alias("codigo"), r["score"].alias("confianca"))).alias("alternativas"),
        F.col("masked").alias("texto_analisado"),
        F.transform("evidences", lambda e: F.struct(e["item"], e["satisfied"].alias("atendida"))).alias("evidencias"),
        F.col("missing").alias("pendencias"),
        entity_counts(F.col("entities")).alias("dados_sensiveis"),
        F.col("discarded_blocks").alias("blocos_descartados"),
        F.struct(F.col("bundle.logs").alias("logs"), F.col("bundle.visuals").alias("visuais"), F.col("bundle.others").alias("outros"), F.col("bundle.total").alias("total")).alias("anexos"),
        F.when(log.isNotNull(), analysis).alias("analise_log"),
        F.col("exit_code").alias("codigo_saida"),
    )


def screening_json() -> Column:
    return F.to_json(document(), KEEP_NULLS)


def report(width: int | None = None, config: Config = DEFAULT) -> Column:
    """The boxed text report of a row of ``screening.screen``; absent parts are null and drop out."""
    n, say, apart, hint = width or config.report_width, fixed.REPORT, fixed.REPORT_DIVERGENCE, fixed.REPORT_HINT
    heavy, light = F.lit("=" * n), F.lit("-" * n)
    log, some = F.col("log_analysis"), F.col("log_analysis").isNotNull()
    hits = some & (log["total_hits"] > 0)
    counts = entity_counts(F.col("entities"))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries(counts), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ", ")
    when = lambda cond, *parts: F.when(cond, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    always = F.lit(True)
    lines = F.array(
        heavy,
        when(always, say["ticket"], F.col("ticket_id")),
        when(always, say["text"], F.col("masked")),
        when(always, say["symptom"], F.col("symptom"), say["confidence"], F.format_number(F.col("confidence") * 100, 1), "%)"),
        F.when(F.col("bundle.total") > 0, F.format_string(say["files"], "bundle.logs", "bundle.visuals", "bundle.others")),
        when(F.size("entities") > 0, say["entities"], listed),
        when(always, say["status"], lookup(F.col("status"), fixed.STATUS_TITLES)),
        F.when(F.col("status") == fixed.BLOCKED, F.concat(F.lit(say["action"] + say["return"]), F.array_join("missing", ", "))).otherwise(F.concat(F.lit(say["action"]), F.col("action"))),
        F.when(F.size("evidences") > 0, light),
        F.when(F.size("evidences") > 0, F.lit(say["evidence"])),
        F.when(F.size("evidences") > 0, F.array_join(F.transform("evidences", lambda e: F.concat(F.when(e["satisfied"], say["met"]).otherwise(say["lacking"]), e["item"])), "\n")),
        F.when(some, light),
        F.when(some & ~hits, F.lit(say["no hits"])),
        when(hits, F.format_string(say["hits"], log["total_hits"], log["scanned_files"]), F.when(log["truncated"], say["first"]).otherwise(""), ":"),
        F.when(hits, F.array_join(F.transform(log["hits"], lambda h: F.concat(F.lit("  - "), h["file_name"], F.lit(":"), h["line_number"].cast("string"), F.lit(" ["), h["label"], F.lit("] "), h["excerpt"])), "\n")),
        when(hits & (F.col("matches_text") == False), apart[0], log["dominant_symptom"], apart[1], F.col("symptom"), apart[2]),  # noqa: E712
        F.when(hits & F.col("matches_text"), F.lit(say["confirmed"])),
        when(hits & F.col("matches_text").isNull(), hint[0], F.coalesce(log["dominant_symptom"], F.lit("")), hint[1]),
        heavy,
    )
    return F.array_join(lines, "\n")


def http_status(status: Column) -> Column:
    return F.when(status == fixed.BLOCKED, 422).otherwise(200)


def problem(slug: Column | str, title: Column | str, status: Column | int, detail: Column | str = "") -> Column:
    """RFC 7807 problem document; an empty detail is left out."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.to_json(F.struct(F.concat(F.lit("/erros/"), as_col(slug)).alias("type"), as_col(title).alias("title"), as_col(status).alias("status"), F.nullif(as_col(detail), F.lit("")).alias("detail")))


def taxonomy() -> dict:
    """The symptoms that can be told, what each demands, and the exit codes."""
    return {
        "sintomas": [{"codigo": s, "descricao": fixed.SYMPTOM_LABELS[s], "evidencias_obrigatorias": [item for item, _ in RULES[s]]} for s in (fixed.UX, fixed.AUDIO, fixed.QUEUE)],
        "codigos_saida": {"aprovado": 0, "bloqueado": 1, "atencao": 2, "erro": fixed.EXIT_ERROR},
    }
