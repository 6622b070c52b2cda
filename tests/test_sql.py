import pytest
from pyspark.sql import functions as F

from tamis import fixed, sql
from tamis.operators.classify import infer, with_grams
from tamis.operators.entities import anonymize
from tamis.plans import workloads

TEXTS = [
    "ligar (11) 98765-4321 hoje, a.b@empresa.com.br", "o botao de tabulacao travou", "it's a \\d test\nof 'quotes' \u0001 and 10.20.30.40",
    "cpf: 12345678900 do titular", "abcd", "", None, "fila travada nao distribui as chamadas " * 300,
]


@pytest.fixture(scope="module")
def registered(spark):
    assert set(sql.register(spark)) == set(sql.functions())
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "n int, text string")
    rows.createOrReplaceTempView("sql_texts")
    return rows


def test_functions_are_the_operators(spark, registered):
    got = spark.sql("select n, anonymize(text) as a, mask_sensitive_data(text) as m, detect_entities(text) as e from sql_texts order by n").collect()
    want = registered.select(anonymize(F.col("text")).alias("a")).orderBy("n").collect()
    assert [r["a"] for r in got] == [r["a"] for r in want]
    assert all(r["m"] == r["a"]["masked"] and r["e"] == r["a"]["entities"] for r in got)


def test_no_python_runs(spark, registered):
    plan = spark.sql("select anonymize(text), symptom_words(text), log_signature(text), ticket_text(text) from sql_texts")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_small_functions(spark, registered):
    row = spark.sql(
        """select is_brazilian_phone('11 98765-4321') as p, has_entity(detect_entities('ligar (11) 98765-4321'), 'TELEFONE', 'ALTA') as high, has_entity(detect_entities('nada'), 'TELEFONE', 'MEDIA') as none,
        attachment_role('a/b.PNG') as r, normalize_header('Ação  Ímpar::') as h, log_signature('sip/480 then packet loss').label as s, log_signature('nada') as quiet,
        ticket_text('Detalhes:\\ndetalhe1 -> oi') as t, is_brazilian_phone(null) as np, log_signature(null) as nl"""
    ).first()
    assert (row.p, row.high, row.none, row.r, row.h, row.s, row.quiet, row.t, row.nl) == (True, True, False, "visual", "acao impar", "SIP Timeout/Erro", None, "oi", None)
    assert not row.np


def test_grams_of_a_word(spark, registered):
    words = ["", "a", "abc", "ação", "\U0001f600x", "palavra" * 9]
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    want = sorted(map(tuple, with_grams(rows.select(F.col("word").alias("w"), "word")).collect()))
    rows.createOrReplaceTempView("sql_words")
    assert sorted(map(tuple, spark.sql("select word, explode(g) from (select word, word_grams(word) as g from sql_words)").collect())) == want


def test_verdict_of_cosines(spark, registered):
    want = infer(spark.createDataFrame([("1", "xxxxx"), ("2", "")], "ticket_id string, masked string")).orderBy("ticket_id").select("inference").collect()
    got = spark.sql("select symptom_of('xxxxx', null) as a, symptom_of('', null) as b").first()
    assert [got.a, got.b] == [r[0] for r in want] and got.b["symptom"] == fixed.TOO_SHORT


def test_catalog_functions_serve_other_sessions(spark):
    spark.sql("create database if not exists desk")
    try:
        assert "`desk`.anonymize" in sql.register(spark, "desk")
        assert spark.newSession().sql("select desk.mask_sensitive_data('ligar (11) 98765-4321')").first()[0] == "ligar [TELEFONE_MASK]"
    finally:
        spark.sql("drop database desk cascade")


def test_screening_text_shuffles_nothing(spark, registered):
    """The n-grams of all tickets are not rows to be shuffled; verdicts are those of the operator."""
    masked = spark.createDataFrame([("1", "ligacao caiu no meio da chamada"), ("2", "xxxxx"), ("3", "")], "ticket_id string, masked string")
    got = spark.sql(workloads._SQL_SCREENING, masked=masked)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted((r["ticket_id"], r["masked"], r["inference"]["symptom"], r["inference"]["confidence"]) for r in infer(masked).collect())
