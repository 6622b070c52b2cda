import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tamis import fixed
from tamis.operators.entities import anonymize, detect, entity_counts, has_entity

#: text -> ((kind, raw, confidence), ...)
CASES = {
    "telefone 11987654321": (("TELEFONE", "11987654321", "ALTA"),),
    "11987654321": (("TELEFONE", "11987654321", "MEDIA"),),
    "12345678900": (("CPF", "12345678900", "MEDIA"),),
    "protocolo 1234567890": (("PROTOCOLO", "1234567890", "ALTA"),),
    "TEL: 987654321": (("TELEFONE", "987654321", "ALTA"),),
    "CNPJ 12.345.678/0001-95": (("CNPJ", "12.345.678/0001-95", "ALTA"),),
    "12345678000195": (("CNPJ", "12345678000195", "MEDIA"),),
    "R$ 1.234,56 e r$ 2,00": (("VALOR", "R$ 1.234,56", "ALTA"), ("VALOR", "r$ 2,00", "ALTA")),
    "R$ 10,5 ou R$ 1000": (),
    "conta: 12345-6": (("CONTA", "conta: 12345-6", "ALTA"),),
    "P125413": (("MATRICULA", "P125413", "ALTA"),),
    "p12345 p1254133": (),
    "contatos 11987654321": (("TELEFONE", "11987654321", "ALTA"),),
    "documentos 12345678900": (("CPF", "12345678900", "ALTA"),),
    "hotel 11987654321": (("TELEFONE", "11987654321", "MEDIA"),),
    "número 987654321": (("PROTOCOLO", "987654321", "ALTA"),),
    "número (11) 98765-4321": (("TELEFONE", "(11) 98765-4321", "ALTA"),),
    "1162345678": (),
    "é12345678900": (),
    "a@b.com 😀 10.0.0.300": (("EMAIL", "a@b.com", "ALTA"), ("IP", "10.0.0.300", "ALTA")),
    "": (),
}


def test_cases(spark):
    rows = spark.createDataFrame([(t,) for t in CASES], "text string").select("text", detect(F.col("text")).alias("e")).collect()
    for r in rows:
        assert tuple((e["kind"], e["raw"], e["confidence"]) for e in r["e"]) == CASES[r["text"]], r["text"]


def test_null_text(spark):
    row = spark.createDataFrame([(None,)], "text string").select(anonymize(F.col("text")).alias("a")).first()
    assert row["a"]["entities"] in (None, [])


@pytest.mark.parametrize("text,masked", [("telefone 11987654321", "telefone [TELEFONE_MASK]"), ("protocolo 1234567890 p125413", "protocolo 1234567890 p125413"), ("a@b.com, conta: 12345-6", "[EMAIL_MASK], [CONTA_MASK]")])
def test_mask(spark, text, masked):
    assert spark.createDataFrame([(text,)], "t string").select(anonymize(F.col("t"))["masked"]).first()[0] == masked


def python_twin(text):
    found = []
    for prio, kind, conf, before, body, after, any_case, check in fixed.ENTITY_RULES:
        for m in re.finditer(f"(?:{before})({body}){after}", text, re.IGNORECASE if any_case else 0):
            d = re.sub(r"\D", "", m.group(1))
            phone = d[:2] in fixed.AREA_CODES and (len(d) == 11 and d[2] == "9" or len(d) == 10 and d[2] in "2345")
            if m.group(1) and (check is None or (check == "phone") == phone):
                found.append((prio, *m.span(1), kind, conf))
    taken = []
    for c in sorted(found):
        if all(c[2] <= t[1] or t[2] <= c[1] for t in taken):
            taken.append(c)
    return sorted((s, e, k, c) for _, s, e, k, c in taken)


def test_whole_tables_against_python(spark):
    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' union all select html from '/root/testdata/sf0.001/pages.parquet'").fetchall() if t]
    texts += [t * 3 for t in CASES]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", detect(F.col("text")).alias("e")).collect()
    for r in rows:
        assert [(e["start"], e["end"], e["kind"], e["confidence"]) for e in r["e"]] == python_twin(r["text"])
        assert all(r["text"][e["start"] : e["end"]] == e["raw"] for e in r["e"])


def test_masking_is_idempotent(spark):
    once = spark.createDataFrame([(t,) for t in CASES], "t string").select(anonymize(F.col("t"))["masked"].alias("a"))
    assert once.where(anonymize(F.col("a"))["masked"] != F.col("a")).count() == 0


def test_counts_and_floor(spark):
    row = spark.createDataFrame([("11987654321 a@b.com e c@d.org",)], "t string").select(detect(F.col("t")).alias("e")).select(entity_counts(F.col("e")).alias("n"), has_entity(F.col("e"), "TELEFONE", "ALTA").alias("high"), has_entity(F.col("e"), "TELEFONE").alias("any")).first()
    assert row["n"] == {"TELEFONE": 1, "EMAIL": 2} and not row["high"] and row["any"]


def test_many_matches_in_one_text(spark):
    """Offsets stay right over many blocks of matches, and time linear: 1 MB of numbers is no trouble."""
    import time

    from tamis.functions.text import BLOCK

    texts = ["é a@b.co " * n + "fim" for n in (1, BLOCK // 2, BLOCK // 2 + 1, BLOCK * 3, 1000)] + ["12 x " * 200_000]
    began = time.time()
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", detect(F.col("text")).alias("e")).collect()
    assert time.time() - began < 60
    for r in rows:
        want = [(m.start(), m.end()) for m in re.finditer("a@b.co", texts[r["i"]])]
        assert [(e["start"], e["end"]) for e in r["e"]] == want and all(e["raw"] == "a@b.co" for e in r["e"])


def test_long_texts_without_digits_in_the_way(spark):
    """Looking at the bones of a text costs no stack, however long it is, and hides no match."""
    fill = "palavra - (outra) / mais. " * 40_000
    texts = [fill + "valor R$  1.234,56 " + fill + "ligar (11) 98765-4321 " + fill, "cc:12345 x ag 123-4", "tel: ١٢٣٤٥-١٢٣٤"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", detect(F.col("text")).alias("e")).collect()
    found = {r["i"]: [(e["kind"], e["raw"]) for e in r["e"]] for r in rows}
    assert found[0] == [("VALOR", "R$  1.234,56"), ("TELEFONE", "(11) 98765-4321")] and [k for k, _ in found[1]] == ["CONTA", "CONTA"] and [k for k, _ in found[2]] == ["TELEFONE"]
