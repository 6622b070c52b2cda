from collections import Counter

import pytest
from pyspark.sql import functions as F

from tamis import fixed
from tamis.operators import classify
from tamis.operators.classify import fit, infer, infer_distinct, label_and_score, parse_symptom

CASES = {
    "ligacao caiu no meio da chamada": (fixed.AUDIO, 0.6078),
    "ligação caiu no meio da chamada": (fixed.AUDIO, 0.6078),
    "lgacao caiu no meio da chmada": (fixed.AUDIO, 0.5634),
    "o botao de tabulacao travou e nao responde ao clique": (fixed.UX, 0.8534),
    "a tela ficou branca e o sistema congelou": (fixed.UX, 0.8422),
    "cliente nao escuta o agente na chamada": (fixed.AUDIO, 0.7724),
    "fila travada nao distribui as chamadas para os atendentes": (fixed.QUEUE, 0.8381),
    "preciso de acesso ao sistema de RH": (fixed.UNKNOWN, 0.3353),
    "bom dia obrigado pelo atendimento": (fixed.UNKNOWN, 0.4637),
    "xxxxx": (fixed.UNKNOWN, 0.0),
    "": (fixed.TOO_SHORT, 0.0),
    "  abcd ": (fixed.TOO_SHORT, 0.0),
    None: (fixed.TOO_SHORT, 0.0),
}


@pytest.fixture(scope="module")
def inferred(spark):
    rows = [(str(i), t) for i, t in enumerate([*CASES, *(t for _, t in fixed.ANCHORS)])]
    return {r["masked"]: r["inference"] for r in infer(spark.createDataFrame(rows, "ticket_id string, masked string")).collect()}


def test_cases(inferred):
    for text, (label, score) in CASES.items():
        assert inferred[text]["symptom"] == label, text
        assert inferred[text]["confidence"] == pytest.approx(score, abs=1e-4), text


def test_anchors_are_their_own_class(inferred):
    assert all(inferred[t]["symptom"] == label and inferred[t]["confidence"] == 1.0 for label, t in fixed.ANCHORS)


def test_runner_ups(inferred):
    x = inferred["preciso de acesso ao sistema de RH"]["runner_ups"]
    assert [r["symptom"] for r in x][:1] == [fixed.UX] and x[0]["score"] == pytest.approx(0.3132, abs=1e-4)
    assert inferred[""]["runner_ups"] == [] and len(inferred["xxxxx"]["runner_ups"]) == 3


def test_model():
    idf, rows = fit()
    assert len(rows) == 33 and len(idf) == 1955 and sum(map(len, rows)) == 3182
    assert min(idf.values()) == pytest.approx(1.5819, abs=1e-4) and max(idf.values()) == pytest.approx(3.8332, abs=1e-4)


def test_wire_values(spark, inferred):
    df = spark.createDataFrame([(fixed.UX,), ("nada",), (None,)], "s string")
    assert [r[0] for r in df.select(parse_symptom(F.col("s"))).collect()] == [fixed.UX, fixed.UNKNOWN, fixed.UNKNOWN]
    row = infer(spark.createDataFrame([("1", "xxxxx")], "ticket_id string, masked string")).select(label_and_score(F.col("inference")).alias("x")).first()
    assert row["x"]["label"] == fixed.UNKNOWN


def test_repeated_texts_are_classified_once(spark, inferred):
    texts = [t for t in CASES if t != ""] * 2
    rows = infer_distinct(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n bigint, masked string")).collect()
    assert len(rows) == len(texts) and all(r["inference"] == inferred[r["masked"]] for r in rows)


def test_texts_are_scored_where_they_stand(spark):
    """No shuffle, and so no task that grows with the n-grams of all texts."""
    rows = spark.createDataFrame([("1", "a ligacao caiu")], "ticket_id string, masked string")
    assert "Exchange" not in infer(rows)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("piece", [classify.PIECE, 7])
def test_counts_are_those_of_the_words(monkeypatch, piece):
    monkeypatch.setattr(classify, "PIECE", piece)
    grams = sorted(fit()[0])
    for text in ["", "a", " \t ", "a b o", "oé de\x1cda fila", "\U0001f600chamada ", "fila" * 40, "　".join(t for _, t in fixed.ANCHORS)]:
        counts = Counter(g for word in text.split() for g in classify.char_grams(word, 3, 5))
        assert classify._counts(text, 3, 5).tolist() == [counts[g] for g in grams]


def test_raw_texts_fold_as_spark_folds(spark):
    """The table by which raw texts are folded says of every character what the expression says."""
    points = spark.range(0x110000).where("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    table = classify._fold_table()
    told = {r["id"]: r["f"] for r in points.select("id", classify.folded(F.col("c")).alias("f"), "c").where("f <> c").collect()}
    codes = classify._codes(3, 5)
    for c in set(told) | {c for c, to in table.items() if to != chr(c)}:
        spark_, own = told.get(c, chr(c)), table.get(c, chr(c))
        assert [codes.get(x, 0) for x in spark_] == [codes.get(x, 0) for x in own], hex(c)
