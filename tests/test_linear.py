"""Long texts with very many matches, fields or lines cost in proportion to their length."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tamis.operators.blocks import as_map, parse_tickets
from tamis.operators.entities import anonymize, mask, mask_sensitive_data, without_overlaps
from tests.test_entities import python_twin

TICKET = "ticket_id string, raw_text string"
PHONES = lambda n: "ligar 11987654321 (11) 98765-4321 é " * (n // 2)
FIELDS = lambda n: "Detalhes:\n" + "".join(f"campo{i} -> valor {i}\n" for i in range(n))


def fastest(df, runs=2):
    seconds = []
    for _ in range(runs):
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        seconds.append(time.time() - began)
    return min(seconds)


@pytest.mark.parametrize("name", ["mask", "map"])  # which detect and parse
def test_one_long_text_costs_as_ten_shorter(spark, name):
    make, long, run = {
        "mask": (PHONES, 50_000, lambda df: df.select(mask_sensitive_data(F.col("raw_text")))),
        "map": (FIELDS, 100_000, lambda df: parse_tickets(df).select(as_map(F.col("parsed")))),
    }[name]
    ten = spark.createDataFrame([(str(i), make(long // 10)) for i in range(10)], TICKET).coalesce(1)
    one = spark.createDataFrame([("0", make(long))], TICKET).coalesce(1)
    few = fastest(run(ten))
    assert fastest(run(one)) < 1.3 * few + 0.5


def test_spans_of_long_texts_against_python(spark):
    rng = random.Random(5)
    parts = ["a.b@c.org", "11987654321", "cpf 12345678900", "(11) 98765-4321", "10.0.0.1", "R$ 1.234,56", "protocolo 123456", "p123456", "conta: 12345-6", "12345678000195", "é", "palavra", "\n", "tel 98765-4321", "1162345678@x.com.br", "😀"]
    texts = [" ".join(rng.choice(parts) for _ in range(n)) for n in (1, 2, 3, 50, 700, 3000)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", anonymize(F.col("t")).alias("a")).collect():
        want, t = python_twin(r["t"]), r["t"]
        assert [(e["start"], e["end"], e["kind"], e["confidence"]) for e in r["a"]["entities"]] == want
        assert all(t[e["start"] : e["end"]] == e["raw"] for e in r["a"]["entities"])
        for start, end, kind, _ in reversed(want):
            if kind not in ("PROTOCOLO", "MATRICULA", "IP"):
                t = t[:start] + f"[{kind}_MASK]" + t[end:]
        assert r["a"]["masked"] == t


def test_masks_at_the_edges_of_pieces(spark):
    """Spans that begin, end or meet where the text is cut, and spans over several pieces."""
    for at, n in ((0, 1), (511, 1), (512, 1), (511, 2), (512, 512), (500, 1600), (1024, 0)):
        text = "ab😀é" * 600
        spans = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("start"), F.lit(e).alias("end")) for k, s, e in (("CPF", at, at + n), ("IP", at + n, at + n + 3), ("EMAIL", at + n + 3, at + n + 4))))
        got = spark.createDataFrame([(text,)], "t string").select(mask(F.col("t"), spans)).first()[0]
        assert got == text[:at] + "[CPF_MASK]" + text[at + n : at + n + 3] + "[EMAIL_MASK]" + text[at + n + 4 :]


def test_overlaps_against_pairs(spark):
    rng = random.Random(8)

    def disjoint(n, most):
        out, at = [], 0
        for _ in range(n):
            at += rng.randrange(3)
            out.append((at, at := at + rng.randint(1, most), "k", "c", "r"))
        return out

    kind = "array<struct<start:int,end:int,kind:string,confidence:string,raw:string>>"
    pairs = [(disjoint(rng.randrange(12), 6), disjoint(rng.randrange(12), 3)) for _ in range(200)]
    for r in spark.createDataFrame(pairs, f"a {kind}, b {kind}").select("a", "b", without_overlaps(F.col("a"), F.col("b")).alias("got")).collect():
        want = sorted([*r["a"], *(b for b in r["b"] if all(b["end"] <= a["start"] or a["end"] <= b["start"] for a in r["a"]))])
        assert [tuple(x) for x in r["got"]] == [tuple(x) for x in want]


def test_fields_of_many_lines(spark):
    """Values over several lines, in several blocks, with blank lines and repeated keys."""
    rng = random.Random(2)
    body, want = "solta\n", []
    for header in ("Detalhes", "Info Solicitante:", "Detalhes :"):
        body += header + "\nantes\n"
        fields = []
        for i in range(200):
            value = [f"v{rng.randrange(9)}" for _ in range(rng.randrange(4))]
            body += f"k{rng.randrange(50)} -> {i}" + "".join(f"\n {v} \n" for v in value) + "\n"
            fields.append(" ".join([str(i), *value]))
        want.append(fields)
    row = parse_tickets(spark.createDataFrame([("1", body)], TICKET)).select("parsed", as_map(F.col("parsed")).alias("m")).first()
    assert [[f["value"] for f in b["fields"]] for b in row["parsed"]["blocks"]] == want
    last = {b["name"]: {f["key"]: f["value"] for f in b["fields"]} for b in row["parsed"]["blocks"]}
    assert row["m"] == last
