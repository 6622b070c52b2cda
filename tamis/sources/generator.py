"""A seeded corpus of tickets and logs, the same rows for the same seed on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis import fixed

NARRATIVES = (
    (fixed.UX, "a tela ficou branca e o sistema congelou"),
    (fixed.UX, "o botao de tabulacao travou e nao responde ao clique"),
    (fixed.AUDIO, "a ligacao caiu no meio da chamada com o cliente"),
    (fixed.AUDIO, "cliente nao escuta o agente na chamada"),
    (fixed.QUEUE, "fila travada nao distribui as chamadas para os atendentes"),
    (fixed.QUEUE, "agente logado nao recebe chamada e a fila acumula clientes"),
)
#: Lines that tell a cause, in the place of its symptom.
CAUSES = {
    fixed.UX: ("GET /api/tab 500 Internal Server Error", "Uncaught ReferenceError: painel is not defined", "FATAL heap out of memory"),
    fixed.AUDIO: ("High Jitter detected: 350ms", "udp packet loss 12% on leg B", "SIP/408 request timeout"),
    fixed.QUEUE: ("ACD_QUEUE error: overflow", "AGENT_STATE 12 mismatch found", "ROUTING_ENGINE: no available agent"),
}
#: Lines that tell nothing; %d is a number.
NOISE = (
    "INFO heartbeat ok seq=%d", "DEBUG cache warm, %d entries", "INFO login done for agent P%06d", "TRACE codec negotiated on channel %d", "DEBUG dns lookup took %d ms",
    "WARN queue depth %d", "INFO call %d bridged", "DEBUG invite from gateway 10.0.0.%d",
)
AREAS = ("Vendas", "Cobranca", "Retencao", "Suporte")
LEAST_LINES, MOST_LINES = 1500, 2500


def _pick(seed: int, salt: str, n: int, *more: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id"), *more), F.lit(n)).cast("int")


def _one_of(values: tuple[str, ...], place: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), place)


def _phone(seed: int, salt: str) -> Column:
    four = lambda part: F.lpad(_pick(seed, f"{salt} {part}", 10_000).cast("string"), 4, "0")
    return F.concat(F.lit("(11) 9"), four("a"), F.lit("-"), four("b"))


def _told(seed: int) -> Column:
    """Stories go round, so a ticket's symptom follows from its number."""
    return F.get(F.array(*(F.struct(F.lit(s).alias("symptom"), F.lit(t).alias("text")) for s, t in NARRATIVES)), F.pmod(F.col("id") + seed, F.lit(len(NARRATIVES))).cast("int"))


def _name() -> Column:
    return F.format_string("req%012d", "id")


def tickets_of(ids: DataFrame, seed: int = 7) -> DataFrame:
    """(ticket_id, raw_text, expected symptom) for each (id): a ticket of all six blocks. Only the narrative tells of the case; phones, times and numbers elsewhere are others'."""
    told, phone = _told(seed), _phone(seed, "affected")
    hour = F.format_string("%02d:%02d", _pick(seed, "h", 24), _pick(seed, "m", 60))
    lines = (
        "Detalhes:", F.concat(F.lit("detalhe1 -> "), told["text"], F.lit(" as "), hour, F.lit(" telefone "), phone, F.lit(" segue print em anexo")), F.format_string("detalhe2 -> agente P%06d", _pick(seed, "agent", 1_000_000)), "",
        "Info Solicitante:", "contatonome -> Fulano de Tal", F.concat(F.lit("contatotelefone -> "), _phone(seed, "other")), F.format_string("contatoemail -> fulano%d@empresa.com.br", _pick(seed, "mail", 1000)), "",
        "Categorizacao:", "categoria -> Telefonia", F.format_string("sla -> %d Horas", _pick(seed, "sla", 8) + 1), F.format_string("codigo -> %08d", _pick(seed, "code", 100_000_000)), "",
        "Info Demandante:", F.concat(F.lit("areasolicitante -> "), _one_of(AREAS, _pick(seed, "area", len(AREAS)))), F.format_string("matriculademandante -> P%06d", _pick(seed, "who", 1_000_000)), "",
        "Info Arquivo:", F.concat(F.lit("anexo -> "), _one_of(("Sim", "Nao"), _pick(seed, "file", 2))), "",
        "Info Fornecedor:", "fornecedor -> Operadora", F.format_string("contrato -> %010d", _pick(seed, "contract", 1_000_000_000)),
    )
    body = F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))
    return ids.select(_name().alias("ticket_id"), body.alias("raw_text"), told["symptom"].alias("expected"))


def log_lines_of(ids: DataFrame, least: int = LEAST_LINES, most: int = MOST_LINES, seed: int = 7) -> DataFrame:
    """(ticket_id, att_ord, file_name, line_number, line) for each (id): noise, and one line that tells the ticket's cause beside its phone."""
    told, count = _told(seed)["symptom"], _pick(seed, "lines", most - least + 1) + least
    cause = F.when(F.lit(False), "")
    for s, texts in CAUSES.items():
        cause = cause.when(told == s, _one_of(texts, _pick(seed, "cause", len(texts))))
    rows = ids.select("id", _name().alias("ticket_id"), count.alias("n"), F.concat(cause, F.lit(" | CallerID: "), _phone(seed, "affected")).alias("cause"))
    rows = rows.select("id", "ticket_id", "cause", F.pmod(F.xxhash64(F.lit(seed), F.lit("at"), "id"), F.col("n")).alias("at"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    number = _pick(seed, "number", 400, F.col("i")).cast("string")
    # only the line's own kind is filled in, with its number
    kind = _one_of(NOISE, _pick(seed, "kind", len(NOISE), F.col("i")))
    noise = F.replace(F.replace(kind, F.lit("%06d"), F.lpad(number, 6, "0")), F.lit("%d"), number)
    text = F.when(F.col("i") == F.col("at"), F.col("cause")).otherwise(noise)
    return rows.select("ticket_id", F.lit(0).alias("att_ord"), F.concat("ticket_id", F.lit("_log.txt")).alias("file_name"), (F.col("i") + 1).cast("bigint").alias("line_number"), F.concat(stamp, F.lit(" "), text).alias("line"))


def tickets(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    return tickets_of(spark.range(n), seed)


def log_lines(spark: SparkSession, n: int, lines: int | None = None, seed: int = 7) -> DataFrame:
    """Logs of as many lines each as asked, or else of 1,500 to 2,500."""
    return log_lines_of(spark.range(n), lines or LEAST_LINES, lines or MOST_LINES, seed)
