import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tamis import fixed
from tamis.operators import anchors as a
from tamis.operators.classify import LABELS, char_grams, fit, infer

ANCHORS = "anchor int, label string, text string"
TEXTS = ["a ligacao caiu no meio da chamada", "o botao travou", "fila travada nao distribui", "preciso de acesso ao sistema de RH", "xxxxx", "", None]


def brute(anchors, texts):
    """{(key, label): (score, anchor)} by the definition, on plain words."""
    counts = [Counter(g for w in t.lower().split() for g in char_grams(w, 3, 5)) for _, _, t in anchors]
    df = Counter(g for c in counts for g in c)
    idf = {g: math.log((1 + len(counts)) / (1 + n)) + 1 for g, n in df.items()}
    weigh = lambda c: {g: (1 + math.log(n)) * idf[g] for g, n in c.items() if g in idf}
    unit = lambda r: {g: w / math.sqrt(sum(x * x for x in r.values())) for g, w in r.items()}
    rows = [unit(weigh(c)) for c in counts]
    out = defaultdict(lambda: (0.0, ""))
    for key, text in texts:
        q = unit(weigh(Counter(g for w in (text or "").lower().split() for g in char_grams(w, 3, 5))))
        for (name, label, _), row in zip(anchors, rows, strict=True):
            score = round(sum(w * row.get(g, 0.0) for g, w in q.items()), 9)
            if score > 0:
                out[key, label] = min(out[key, label], (score, str(name)), key=lambda x: (-x[0], x[1]))
    return dict(out)


@pytest.fixture(scope="module")
def small(spark):
    return a.fit_anchors(spark.createDataFrame([(i, label, t) for i, (label, t) in enumerate(fixed.ANCHORS)], ANCHORS))


def test_fit_is_that_of_the_driver(small):
    idf, rows = fit()
    at = {(r["block"], r["place"]): int(r["anchor"]) for r in small.places.collect()}
    got, firsts = {}, Counter()
    for c in small.cells.collect():
        assert c["idf"] == pytest.approx(idf[c["gram"]], abs=1e-12)
        firsts[c["gram"]] += c["first"]
        got |= {(c["gram"], at[c["block"], i]): w for i, w in enumerate(c["weights"]) if w}
    assert set(at.values()) == set(range(33)) and set(firsts) == set(idf) and set(firsts.values()) == {1}
    assert got == pytest.approx({(g, i): w for i, row in enumerate(rows) for g, w in row.items()}, abs=1e-12)


def test_scores_are_those_of_infer(spark, small):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "ticket_id string, masked string")
    got = {(r["ticket_id"], r["label"]): r["score"] for r in a.label_scores(rows, small).collect()}
    for r in infer(rows).collect():
        told = [(r["inference"]["symptom"], r["inference"]["confidence"])] + [(x["symptom"], x["score"]) for x in r["inference"]["runner_ups"]]
        mine = sorted(round(got.get((r["ticket_id"], label), 0.0), 4) for label in LABELS)
        if r["inference"]["symptom"] != fixed.TOO_SHORT:
            assert mine == pytest.approx(sorted(s for _, s in told), abs=1e-4)
    assert not any(k in ("4", "5", "6") for k, _ in got)


@pytest.fixture(scope="module")
def many():
    words = "fila chamada agente botao tela sistema acesso ramal audio ligacao grava pausa senha rede link".split()
    pick = lambda i, n: " ".join(words[(i * 7 + j * (i % 5 + 1)) % len(words)] + (str(i % 3) if j % 4 == 0 else "") for j in range(n))
    return [(i, f"l{i % 7}", pick(i, 3 + i % 6)) for i in range(300)], [(f"t{i}", pick(i * 3 + 1, 1 + i % 9)) for i in range(80)]


@pytest.mark.parametrize("limit", [a.BROADCAST_ROWS, 0])
def test_many_blocks_against_brute_force(spark, many, monkeypatch, limit):
    """Anchors of several blocks and buckets, many of them alike; with the model sent to all tasks, and met by n-gram."""
    monkeypatch.setattr(a, "BUCKET", 120)
    monkeypatch.setattr(a, "BROADCAST_ROWS", limit)
    rows, texts = many
    model = a.fit_anchors(spark.createDataFrame(rows, ANCHORS))
    assert model.places.select("block").distinct().count() >= 19
    data = spark.createDataFrame(texts, "ticket_id string, masked string")
    want = brute(rows, texts)
    got = {(r["ticket_id"], r["label"]): (r["score"], r["anchor"]) for r in a.label_scores(data, model).collect()}
    assert got.keys() == want.keys()
    for k, (score, anchor) in want.items():
        assert got[k][0] == pytest.approx(score, abs=2e-9) and got[k][1] == anchor, k
    near = {r["ticket_id"]: (r["score"], r["label"], r["anchor"]) for r in a.nearest_anchor(data, model).collect()}
    for t in {k for k, _ in want}:
        score, label, anchor = min(((s, label, x) for (k, label), (s, x) in want.items() if k == t), key=lambda x: (-x[0], x[1], x[2]))
        assert near[t][1:] == (label, anchor) and near[t][0] == pytest.approx(score, abs=2e-9)


def test_odd_tables(spark):
    texts = spark.createDataFrame([("1", "alfa beta", 3), (None, "alfa", 4), ("2", "alfa " * 20000, 5)], "ticket_id string, masked string, gram int")
    none = a.fit_anchors(spark.createDataFrame([], ANCHORS))
    assert none.rows == 0 and a.label_scores(texts, none).count() == 0 and a.nearest_anchor(texts, none).count() == 0
    rows = [(1, "x", "alfa"), (1, "x", "alfa"), (1, "y", "alfa"), (2, "x", None), (3, None, "beta"), (4, "z", ""), (None, "w", "alfa")]
    odd = a.fit_anchors(spark.createDataFrame(rows, ANCHORS).withColumn("key", F.lit(0)).withColumn("gram", F.lit(1)))
    assert odd.places.count() == 4
    got = {(r["ticket_id"], r["label"]): r["score"] for r in a.label_scores(texts, odd).collect()}
    assert got == {(t, label): 1.0 for t in "12" for label in "xyw"}
    assert {r["label"] for r in a.nearest_anchor(texts, odd).collect()} == {"w"}
    assert a.label_scores(texts.limit(0), odd).count() == 0


def test_few_texts_meet_a_large_model_where_it_lies(spark, many, monkeypatch):
    """Cells of a large model are not shuffled for few texts, and results are the same where both are."""
    monkeypatch.setattr(a, "BROADCAST_ROWS", 0)
    rows, texts = many
    model, data = a.fit_anchors(spark.createDataFrame(rows, ANCHORS)), spark.createDataFrame(texts, "ticket_id string, masked string")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    near = a.nearest_anchor(data, model)
    assert "SortMergeJoin [gram" not in plan(near)
    monkeypatch.setattr(a, "BROADCAST_COUNTS", 0)
    merged = a.nearest_anchor(data, model)
    assert "SortMergeJoin [gram" in plan(merged) and sorted(map(tuple, near.collect())) == sorted(map(tuple, merged.collect()))


def test_only_the_small_models_grams_are_summed(spark, small):
    rows = spark.createDataFrame([("1", "a ligacao caiu zzzzzz")], "ticket_id string, masked string")
    assert "LeftSemi" in a.label_scores(rows, small)._jdf.queryExecution().optimizedPlan().toString()
