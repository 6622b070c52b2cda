import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tamis import fixed
from tamis.functions.render import problem, report, screening_json, taxonomy
from tamis.operators.screening import role, screen
from tamis.service import handle, main, read_interactive, readable_limit
from tamis.config import Config

AUDIO = "a ligacao caiu no meio da chamada com o cliente"
TICKETS = [
    ("ok", f"Detalhes:\ndetalhe1 -> {AUDIO} as 14:30 telefone (11) 98765-4321", fixed.AUDIO, "APROVADO", []),
    ("no time", f"Detalhes:\ndetalhe1 -> {AUDIO} telefone (11) 98765-4321", fixed.AUDIO, "BLOQUEADO", [fixed.ITEM_TIME]),
    ("bare", f"Detalhes:\ndetalhe1 -> {AUDIO} as 14h30 11987654321", fixed.AUDIO, "BLOQUEADO", [fixed.ITEM_PHONE]),
    ("ux", "a tela ficou branca e o sistema congelou", fixed.UX, "BLOQUEADO", [fixed.ITEM_ARTIFACT]),
    ("ux print", "a tela ficou branca e o sistema congelou, segue print", fixed.UX, "APROVADO", []),
    ("queue", "fila travada nao distribui as chamadas, prazo 4 horas", fixed.QUEUE, "BLOQUEADO", [fixed.ITEM_TIME]),
    ("other", "preciso de acesso ao sistema de RH", fixed.UNKNOWN, "ATENCAO", []),
    ("short", "Detalhes:\ndetalhe1 ->", fixed.TOO_SHORT, "ATENCAO", []),
]


@pytest.fixture(scope="module")
def screened(spark):
    tickets = spark.createDataFrame([t[:2] for t in TICKETS], "ticket_id string, raw_text string")
    attachments = spark.createDataFrame([("ux", 0, "nota.docx"), ("ok", 0, "a.LOG"), ("ok", 1, "b.txt"), ("other", 0, "c.log"), ("bare", 0, "d.log")], "ticket_id string, ord int, name string")
    lines = spark.createDataFrame([("ok", 0, "a.LOG", 1, "packet loss"), ("ok", 1, "b.txt", 4, "heap out of memory"), ("ok", 1, "b.txt", 5, "sip/404"), ("bare", 0, "d.log", 1, "heap out of memory")], "ticket_id string, att_ord int, file_name string, line_number bigint, line string")
    return screen(tickets, attachments, lines)


def test_status_and_missing(screened):
    rows = {r["ticket_id"]: r for r in screened.collect()}
    for key, _, symptom, status, lacking in TICKETS:
        assert (rows[key]["symptom"], rows[key]["status"], rows[key]["missing"]) == (symptom, status, lacking), key
        assert rows[key]["exit_code"] == fixed.EXIT_CODES[status]
    assert rows["ok"]["matches_text"] is True and rows["bare"]["has_divergence"] and rows["ux"]["log_analysis"] is None
    assert rows["other"]["log_analysis"]["total_hits"] == 0 and rows["other"]["matches_text"] is None


def test_repeated_ticket_ids_have_verdicts_of_their_own(spark):
    """Rows of one id are told apart by their text; rows without an id are screened, too."""
    rows = [("a", "fila travada nao distribui as chamadas"), ("a", "audio picotando cortando durante a chamada"), ("a", "audio picotando cortando durante a chamada"), (None, "fila travada nao distribui as chamadas"), (None, "xxxxx yyyyy")]
    alone = {t: screen(spark.createDataFrame([("1", t)], "ticket_id string, raw_text string")).first() for t in {t for _, t in rows}}
    got = screen(spark.createDataFrame(rows, "ticket_id string, raw_text string")).collect()
    assert sorted(((r["ticket_id"], r["masked"], r["symptom"], r["confidence"]) for r in got), key=str) == sorted(((i, t, alone[t]["symptom"], alone[t]["confidence"]) for i, t in rows), key=str)
    assert {alone[t]["symptom"] for _, t in rows} == {fixed.QUEUE, fixed.AUDIO, fixed.UNKNOWN}


def test_json_contract(screened):
    rows = {r["ticket_id"]: json.loads(r["j"]) for r in screened.select("ticket_id", screening_json().alias("j")).collect()}
    assert list(rows["ok"]) == ["chamado", "status", "acao_necessaria", "sintoma", "confianca", "alternativas", "texto_analisado", "evidencias", "pendencias", "dados_sensiveis", "blocos_descartados", "anexos", "analise_log", "codigo_saida"]
    assert rows["ux"]["analise_log"] is None and rows["ok"]["analise_log"]["contagem_por_sintoma"] == {fixed.AUDIO: 2, fixed.UX: 1}
    assert rows["ok"]["analise_log"]["arquivos_lidos"] == 2 and rows["ok"]["dados_sensiveis"] == {"TELEFONE": 1} and "98765" not in json.dumps(rows)
    assert rows["other"]["analise_log"]["confere_com_texto"] is None and "causa_dominante" in rows["other"]["analise_log"]


def test_report(screened):
    rows = {r["ticket_id"]: r["t"] for r in screened.select("ticket_id", report().alias("t")).collect()}
    assert rows["ok"].startswith("=" * 50 + "\n[CHAMADO]          : ok\n") and "[CONFIRMAÇÃO]" in rows["ok"] and "[ANEXOS]           : 2 log(s), 0 evidência(s) visual(is), 0 outro(s)" in rows["ok"]
    assert "[⚠️ DIVERGÊNCIA]" in rows["bare"] and "  [FALTA] " + fixed.ITEM_PHONE in rows["bare"] and "  [OK  ] " + fixed.ITEM_TIME in rows["bare"]
    assert "Nenhuma assinatura" in rows["other"] and "ANÁLISE DE LOG" not in rows["ux"]
    assert "cobrando: " + fixed.ITEM_ARTIFACT in rows["ux"]


def test_confidence_is_rounded_as_written(spark):
    """One digit of the number's exact value: 0.15 as a percentage is just below the middle, and other formats round it up."""
    from tamis.functions.render import report

    row = {"ticket_id": "1", "masked": "x", "symptom": fixed.UX, "status": "APROVADO", "action": "a"}
    base = spark.createDataFrame([(*row.values(), i / 10000) for i in range(0, 10001, 25)], ", ".join(f"{k} string" for k in row) + ", confidence double")
    empty = screen(spark.createDataFrame([], "ticket_id string, raw_text string")).drop(*row, "confidence")
    whole = base.select("*", *(F.lit(None).cast(t).alias(n) for n, t in empty.dtypes))
    for r in whole.select("confidence", report().alias("t")).collect():
        assert f"(Confiança: {r['confidence'] * 100:.1f}%)" in r["t"]


def test_roles(spark):
    names = {"a.LOG": "log", "b.JPeG": "visual", "c.zip": "other", ".log": "other", "x/y.tar.out": "log", "none": "other", "dot.": "other"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", role(F.col("n")).alias("r")).collect()
    assert {r["n"]: r["r"] for r in got} == names


def test_service(spark):
    config = Config(api_max_content_length=2000)
    post = lambda body: handle(spark, "POST", "/api/v1/screenings", body, config)
    status, kind, body = post(json.dumps({"texto": "a tela ficou branca e o sistema congelou"}).encode())
    assert status == 422 and json.loads(body)["pendencias"] == [fixed.ITEM_ARTIFACT]
    assert post(json.dumps({"text": "bom dia obrigado pelo atendimento"}).encode())[0] == 200
    assert post(b'{"texto": "  "}')[0] == 400 and post(b"[1]")[0] == 500 and post(b"x" * 3000)[0] == 413
    assert handle(spark, "GET", "/readyz", b"", config)[0] == 200 and handle(spark, "GET", "/healthz", b"", config)[0] == 200
    assert handle(spark, "GET", "/nada", b"", config)[0] == 404 and json.loads(handle(spark, "GET", "/api/v1/symptoms", b"", config)[2]) == taxonomy()
    assert [readable_limit(n) for n in (32 << 20, 2048, 100)] == ["32 MB", "2 KB", "100 bytes"]


def test_problem_without_detail(spark):
    assert json.loads(spark.range(1).select(problem("x", "t", 400)).first()[0]) == {"type": "/erros/x", "title": "t", "status": 400}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "req1.md").write_text("a tela ficou branca e o sistema congelou")
    (tmp_path / "app.log").write_text("INFO\npacket loss\n")
    code = main(["--file", str(tmp_path / "req1.md"), "--attachments", str(tmp_path / "app.log"), str(tmp_path / "gone.log"), "--json"], spark)
    body = json.loads(capsys.readouterr().out)
    assert code == 0 and body["chamado"] == "req1" and body["analise_log"]["causa_dominante"] == fixed.AUDIO
    (tmp_path / "blank.md").write_text(" \n")
    assert main(["--file", str(tmp_path / "blank.md")], spark) == fixed.EXIT_ERROR
    assert list(read_interactive(["um\n", "\n", "  dois\n", " fim \n", " \n", "FIM\n", "x\n", "Fim", "y\n"])) == ["um\n\n  dois", "x"]


def test_command_line_sources(spark, tmp_path, capsys, monkeypatch):
    spark.catalog.clearCache()
    for argv in ([], ["--text", "a", "--text-file", "b"], ["--text", "a", "--api-source"], ["--what"]):
        with pytest.raises(SystemExit) as stop:
            main(argv, spark)
        assert stop.value.code == 2
    assert main(["--text-file", str(tmp_path / "gone.md")], spark) == fixed.EXIT_ERROR
    (tmp_path / "req7.md").write_bytes("Detalhes:\ndetalhe1 -> a ligação caiu no meio da chamada às 14:30".encode("cp1252"))
    (tmp_path / "req7_log.txt").write_text("packet loss\n")
    capsys.readouterr()
    code = main(["--api-source", "--pool", str(tmp_path), "--json"], spark)
    body = json.loads(capsys.readouterr().out)
    assert code == 1 and body["chamado"] == "req7" and body["analise_log"]["confere_com_texto"] is True
    monkeypatch.setattr("sys.stdin", io.StringIO("bom dia obrigado\nFIM\n\nFIM\na tela ficou branca e o sistema congelou\nfim\n"))
    assert main(["--interactive"], spark) == 0
    assert capsys.readouterr().out.count("[CHAMADO]          : interativo") == 2
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_uploads(spark):
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("app.log", "packet loss\nSIP/408\n")
    edge = "----x"

    def send(*parts, kind=f"multipart/form-data; boundary={edge}"):
        body = b"".join(b"--" + edge.encode() + b"\r\nContent-Disposition: form-data; " + head.encode() + b"\r\n\r\n" + data + b"\r\n" for head, data in parts) + b"--" + edge.encode() + b"--\r\n"
        return handle(spark, "POST", "/api/v1/screenings", body, Config(), kind)

    text = ('name="texto"', "a tela ficou branca e o sistema congelou".encode())
    assert send(text)[0] == 422
    status, _, body = send(text, ('name="anexos"; filename="foto 1.PNG"', b"\x89PNG"), ('name="attachments"; filename="logs.zip"', archive.getvalue()), ('name="anexos"; filename="nota.docx"', b"x"), ('name="outro"; filename="a.log"', b"x"))
    body = json.loads(body)
    assert status == 200 and body["anexos"] == {"logs": 1, "visuais": 1, "outros": 0, "total": 2} and body["analise_log"]["ocorrencias"] == 2
    status, kind, body = send(text, ('name="anexos"; filename="bad.zip"', b"no zip"))
    assert status == 400 and kind == "application/problem+json" and json.loads(body)["type"] == "/erros/anexo-invalido"
    assert send(('name="text"', b" "))[0] == 400
    assert handle(spark, "POST", "/api/v1/screenings", "texto=bom+dia+obrigado".encode(), Config(), "application/x-www-form-urlencoded")[0] == 200
