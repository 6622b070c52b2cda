"""Tickets, attachments and log lines made from the test tables by rule.

The tables hold no tickets or logs. These SQL texts build them from ``documents``, ``pages`` and ``events`` in
the dialect that Spark and DuckDB share, so both engines start from the same strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamis.sources.tables import read_table

#: One shape of span or cue each.
FRAGMENTS = (
    "contato fulano.tal@empresa.com.br por favor",
    "CNPJ 12.345.678/0001-95 do cliente",
    "documento 123.456.789-00 informado",
    "valor R$ 1.234,56 cobrado",
    "no servidor 10.20.30.40 da rede",
    "protocolo 1234567890 aberto",
    "cpf: 12345678900 do titular",
    "TEL: 987654321 para retorno",
    "conta: 12345-6 do cliente",
    "ligar (11) 98765-4321 hoje",
    "ligar 11 98765-4321 hoje",
    "ramal 98765-4321 interno",
    "agente P125413 relatou",
    "numero 11987654321 e 12345678900",
    "registro 12345678000195 e 1162345678",
    "sem dados adicionais",
)
STORIES = (
    "a ligacao caiu no meio da chamada com o cliente",
    "o botao de tabulacao travou e nao responde ao clique",
    "fila travada nao distribui as chamadas para os atendentes",
    "preciso de acesso ao sistema de RH",
    "",
)
LINES = (
    "GET /x returned 503 from HTTP gateway",
    "Uncaught TypeError in tab",
    "FATAL heap out of memory",
    "High Jitter detected: 350ms",
    "udp packet loss on leg",
    "SIP/408 request timeout",
    "ACD_QUEUE 7 overflow",
    "AGENT_STATE 12 mismatch found",
    "ROUTING_ENGINE: no available agent",
    "sip/480 then packet loss",
    "INFO heartbeat ok",
    "DEBUG cache warm",
    "INFO login done",
)
ATTACHMENTS = ("captura.PNG", "saida.LOG", "dados.csv", "pacote.zip", "foto.jpeg", "semsufixo", ".log", "relatorio.final.PDF", "nota.docx")


def _case(key: str, values: tuple[str, ...]) -> str:
    return f"case {key} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


NARRATIVES = f"""
select cast(doc_id as string) as ticket_id, doc_id,
       trim({_case("doc_id % 5", STORIES)} || ' ' || coalesce(text, '') || ' ' || {_case("doc_id % 16", FRAGMENTS)}
       || case when doc_id % 3 = 0 then ' desde 14:30' else '' end
       || case when doc_id % 7 = 0 then ' segue print' else '' end) as text
from {{documents}}"""

_REQUESTER = "'Info Solicitante:' || chr(10) || 'contatonome -> Fulano' || chr(10) || 'contatotelefone -> 11 91234-5678'"
_OTHER = "chr(10) || chr(10) || 'Categorizacao:' || chr(10) || 'categoria -> Telefonia' || chr(10) || 'sla -> 4 Horas'"
TICKETS = f"""
select ticket_id, case doc_id % 8
    when 0 then 'Detalhes:' || chr(10) || 'detalhe1 -> ' || text || chr(10) || chr(10) || {_REQUESTER} || {_OTHER}
    when 1 then 'DETALHES:' || chr(10) || 'detalhe1 -> ' || text || chr(10) || 'detalhe2 -> outro' || chr(10) || {_REQUESTER}
    when 2 then 'Detalhes' || chr(10) || 'DETALHE1 -> ' || text || chr(10) || 'continua na linha' || {_OTHER}
    when 3 then 'Info  Solicitante' || chr(10) || 'contatonome -> Beltrano' || chr(10) || 'Detalhes :' || chr(10) || 'obs -> ' || text
    when 4 then {_REQUESTER} || chr(10) || 'Detalhes:' || chr(10) || 'detalhe1 -> ' || text
    when 5 then {_REQUESTER} || chr(10) || 'obs -> ' || text
    when 6 then 'Detalhes:' || chr(10) || 'detalhe1 ->' || chr(10) || 'detalhe2 -> ' || text
    else 'preambulo' || chr(10) || 'Detalhes:' || chr(10) || 'detalhe1 -> ' || text || chr(10) || 'Detalhes:' || chr(10) || 'detalhe1 -> repetido' end as raw_text
from ({NARRATIVES})"""

LOG_LINES = f"""
select cast(user_id as string) as ticket_id, 0 as att_ord, 'app.log' as file_name, event_id as line_number,
       '  ' || {_case("event_id % 13", LINES)} || ' | tel (11) 98765-4321 user=' || cast(user_id as string) as line
from {{events}}"""

FILES = f"""
select cast(page_id % 40 as string) as ticket_id, page_id as ord, 'p' || cast(page_id as string) || {_case("page_id % 9", tuple(a if a.startswith(".") else "/" + a for a in ATTACHMENTS))} as name
from {{pages}}"""


def read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [n for n in ("documents", "events", "pages") if f"{{{n}}}" in sql]
    return spark.sql(sql, **{n: read_table(spark, sf_dir, n) for n in names})


def duck(sql: str) -> str:
    for n in ("documents", "events", "pages"):
        sql = sql.replace(f"{{{n}}}", n)
    return sql
