import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tamis import scratch
from tamis.config import Config
from tamis.operators import search as s
from tamis.operators.anchors import fit_anchors, nearest_anchor
from tamis.operators.classify import char_grams
from tamis.plans import workloads
from tamis.plans.workloads import QUERIES
from tests.test_anchors import ANCHORS, brute, many  # noqa: F401

ODD = ["", "a", " a  b ", "ab\tab abc\x1cabc　abcdef", "日本語 の日本 x", "a\x00b a\x00 ab", "ção não 𝒳yz 😀 😀", "x" * 700 + " " + "yz" * 90, "a b " * 300]


def test_counts_are_those_of_the_words(monkeypatch):
    dice = random.Random(4)
    texts = ODD + ["".join(dice.choice("ab ção日\x00\n😀z") for _ in range(dice.randrange(80))) for _ in range(200)]
    for piece in (s.PIECE, 7, 64):
        monkeypatch.setattr(s, "PIECE", piece)
        for config in (Config(), Config(nlp_ngram_min=1, nlp_ngram_max=2), Config(nlp_ngram_min=4, nlp_ngram_max=7), Config(nlp_ngram_min=6, nlp_ngram_max=6)):
            for text in texts:
                keys, n, odd = s.gram_counts(text, config)
                names = s._spelled(keys)
                assert s._numbered(names + list(odd)).tolist() == keys.tolist() + [0] * len(odd)
                want = Counter(g for w in text.split() for g in char_grams(w, config.nlp_ngram_min, config.nlp_ngram_max))
                assert dict(zip(names, n.tolist(), strict=True)) | odd == want, (text, config)


def near(rows):
    return {r["ticket_id"]: (r["label"], r["anchor"], r["score"]) for r in rows.collect()}


@pytest.mark.parametrize(("block", "dense", "worth", "texts"), [(s.BLOCK_BYTES, s.DENSE_BYTES, s.DENSE_WORTH, s.TEXTS), (700, 0, 100, 7), (300, 4000, 10**6, 256)])
def test_blocks_against_brute_force(spark, many, monkeypatch, block, dense, worth, texts):  # noqa: F811
    """In one block and in many, by postings, by products and by both; copies of texts under other names, of other labels too."""
    for name, value in (("BLOCK_BYTES", block), ("DENSE_BYTES", dense), ("DENSE_WORTH", worth), ("TEXTS", texts)):
        monkeypatch.setattr(s, name, value)
    rows, asked = many
    rows = rows + [(1000 + i, "copy" if i % 3 else "a", t) for i, _, t in rows[::9]]
    data, table = spark.createDataFrame(asked, "ticket_id string, text string"), spark.createDataFrame(rows, ANCHORS)
    # by this process too, where the settings above hold
    got = near(s.nearest_of(data, table))
    want = {}
    for (key, label), (score, anchor) in brute(rows, asked).items():
        want[key] = min(want.get(key, (0.0, "~", "")), (-score, label, anchor))
    assert got.keys() == want.keys()
    for key, (minus, label, anchor) in want.items():
        assert got[key][:2] == (label, anchor) and got[key][2] == pytest.approx(-minus, abs=2e-9), key
    grams = Counter(g for _, _, t in rows for w in t.split() for g in char_grams(w, 3, 5))
    held = s.Block(Config())
    held.know(list(grams), s.np.ones(len(grams)), s.np.full(len(grams), len(asked)))
    for anchor, label, t in rows:
        held.add(label, str(anchor), t)
    held.close(len(asked))
    plain = lambda t: {g: 1 + s.np.log(n) for g, n in Counter(x for w in t.split() for x in char_grams(w, 3, 5)).items()}
    found, unit = held.cosines([(t, 1.0) for _, t in asked[:9]]), [plain(t) for _, _, t in rows]
    for k, (_, t) in enumerate(asked[:9]):
        q = plain(t)
        assert found[k].tolist() == pytest.approx([sum(w * q.get(g, 0.0) for g, w in r.items()) / sum(w * w for w in r.values()) ** 0.5 for r in unit], abs=1e-12)


def test_odd_tables(spark):
    texts = spark.createDataFrame([("1", "alfa beta"), (None, "alfa"), ("2", "alfa " * 20000), ("3", None), ("4", " "), ("5", "zzz"), ("6", "be"), ("6", "ta alfa"), ("7", "日本"), ("8", "ALFÁ")], "ticket_id string, text string")
    assert s.nearest_of(texts, spark.createDataFrame([], ANCHORS)).count() == 0
    rows = [(1, "x", "alfa"), (1, "x", "alfa"), (1, "y", "alfa"), (2, "x", None), (3, None, "beta"), (4, "z", ""), (None, "w", "alfa"), (5, "cjk", "日本 日本語"), (6, "v", "beta alfa beta")]
    odd = spark.createDataFrame(rows, ANCHORS).withColumn("digest", F.lit(0)).withColumn("gram", F.lit(1))
    got = near(s.nearest_of(texts, odd))
    assert got.keys() == {"1", "2", "6", "7", "8"} and got["2"] == got["8"] == ("w", None, 1.0) and got["7"][:2] == ("cjk", "5")
    want = near(nearest_anchor(texts, fit_anchors(odd), text="text"))
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert {k: v[2] for k, v in got.items()} == pytest.approx({k: v[2] for k, v in want.items()}, abs=2e-9)
    assert s.nearest_of(texts.limit(0), odd).count() == 0


def test_longest_of_many_grams(spark, monkeypatch):
    """Counts that are handed on in parts add up."""
    batches = spark.createDataFrame([(0, t, 2) for t in ODD * 3] + [(1, "abc", 1)], "block int, words string, copies bigint").toArrow().to_batches()
    total = lambda: {k: v for k, v in sum((Counter({(r["block"], r["gram"]): r["n"]}) for b in s._frequencies(iter(batches), Config()) for r in b.to_pylist()), Counter()).items()}
    whole = total()
    assert whole[0, " ab"] == 12 and whole[1, "abc"] == 1
    monkeypatch.setattr(s, "COUNTED", 5)
    assert total() == whole


def test_tables_grow_with_the_text_only(spark, monkeypatch):
    """What is stored and shuffled is of the size of the anchors' texts, not of their n-grams, which are about 15 times as much."""
    made, shuffled = [], lambda: sum(x.shuffleWriteBytes() for x in stages(spark))
    path, d = scratch.path, "/root/testdata/sf0.01"
    monkeypatch.setattr(scratch, "path", lambda *a: made.append(path(*a)) or made[-1])
    before = shuffled()
    assert QUERIES["nearest_labelled"](spark, d).count()
    size = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").agg(F.sum(F.octet_length("text"))).first()[0]
    on_disk = sum(f.stat().st_size for p in made for f in Path(p.removeprefix("file:")).rglob("*.parquet"))
    assert on_disk < 2 * size and shuffled() - before < 8 * size, (on_disk, shuffled() - before, size)


def test_labels_are_sent_or_met(spark, monkeypatch):
    """Few labels are sent to the documents by whatever threshold Spark has; the rows are the same where many are met by number."""
    run = lambda: sorted(map(tuple, QUERIES["nearest_labelled"](spark, "/root/testdata/sf0.001").collect()))
    sent = run()
    monkeypatch.setattr(workloads, "_BROADCAST_LABELS", 0)
    assert sent and run() == sent


def stages(spark):
    sc = spark.sparkContext
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]
