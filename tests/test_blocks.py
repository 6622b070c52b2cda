import pytest
from pyspark.sql import functions as F

from tamis.functions.text import normalize_header, split_lines
from tamis.operators.blocks import as_map, parse_tickets


def parsed(spark, body):
    return parse_tickets(spark.createDataFrame([("1", body)], "ticket_id string, raw_text string")).first()


@pytest.mark.parametrize("header", ["Detalhes:", "DETALHES", "  detalhes  :", "Detalhes"])
def test_headers(spark, header):
    assert parsed(spark, f"{header}\ndetalhe1 -> caiu\ndetalhe2 -> isca")["analysis_text"] == "caiu"


def test_order_and_discarded(spark):
    row = parsed(spark, "Info Solicitante:\ncontatonome -> F\nCategorização:\nsla -> 4\nDetalhes:\ndetalhe1 -> x")
    assert row["analysis_text"] == "x" and row["discarded_blocks"] == ["info solicitante", "categorizacao"]


def test_blank_narrative_is_empty(spark):
    assert parsed(spark, "Detalhes:\ndetalhe1 ->\ndetalhe2 -> isca")["analysis_text"] == ""


def test_values_without_narrative(spark):
    assert parsed(spark, "Detalhes:\nobs -> um\noutro -> dois\nvazio ->")["analysis_text"] == "um\ndois"


def test_no_details_is_whole_body(spark):
    assert parsed(spark, " Info Solicitante:\ncontatonome -> F\n")["analysis_text"] == "Info Solicitante:\ncontatonome -> F"
    assert parsed(spark, "Detalhes:\nsem campo")["analysis_text"] == "Detalhes:\nsem campo"


def test_continuation_delimiter_and_preamble(spark):
    row = parsed(spark, "preambulo\nx -> y\nDetalhes:\nsolta\ndetalhe1 -> a -> b\n  mais \n\nOutra Coisa:\nfim")
    assert row["analysis_text"] == "a -> b mais Outra Coisa: fim"


def test_duplicate_blocks_first_wins(spark):
    row = parsed(spark, "Detalhes:\ndetalhe1 -> um\nDetalhes:\ndetalhe1 -> dois")
    assert row["analysis_text"] == "um" and len(row["parsed"]["blocks"]) == 2


def test_marks_spaces_and_breaks(spark):
    assert parsed(spark, "﻿Info Arquivo:\r\nanexo -> a\r\nDetalhes:\r\ndetalhe1 -> ok")["analysis_text"] == "ok"


def test_map_last_wins(spark):
    df = parse_tickets(spark.createDataFrame([("1", "Detalhes:\na -> 1\na -> 2")], "ticket_id string, raw_text string"))
    assert df.select(as_map(F.col("parsed"))).first()[0] == {"detalhes": {"a": "2"}}


def test_null_and_empty(spark):
    for body in (None, ""):
        row = parsed(spark, body)
        assert row["analysis_text"] == "" and not row["parsed"]["is_structured"]


def test_normalize_and_lines(spark):
    row = spark.createDataFrame([("  Informação   ÍMPAR :: ", "a\r\nb\u0085c d\n")], "h string, t string").select(normalize_header(F.col("h")), split_lines(F.col("t"))).first()
    assert row[0] == "informacao impar" and row[1] == "a\r\nb\u0085c d\n".splitlines()
