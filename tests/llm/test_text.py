import itertools
import math
import random
import re
import time
from collections import Counter

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__
from tamis.llm import curriculum, decontaminate, html_extract, language_id, pii, url_filter

SF = "/root/testdata/sf0.001"


# ---- language ---------------------------------------------------------------------------------------------
def test_language_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train_held_in(docs)
    rows = language_id.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "é"), (5, "the of and " * 3000), (5, "a"), (None, "ß")], "doc_id bigint, text string").withColumn("score", F.lit("x"))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(odd, model).collect()]
    assert len(got) == 7 and {d: p for d, p, _ in got[:5]} | {} == {1: "und", 2: "und", 3: "und", 4: got[3][1], 5: "en"}
    assert all(s == 0 if p == "und" else 0 < s <= 1 for _, p, s in got)
    kept = language_id.accept(odd, model).collect()
    assert {r["doc_id"] for r in kept} <= {4, 5, None} and kept[0]["score"] == "x"


def test_language_of_nothing(no_documents):
    model = language_id.train(no_documents)
    assert model.langs == [] and language_id.predict(no_documents, model).count() == 0


def test_language_unlearned(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id bigint, text string")
    assert language_id.predict(docs, language_id.train(docs.withColumn("lang", F.lit(None).cast("string")))).first()["lang_pred"] == "und"


def test_language_score_is_additive_by_row():
    """A batch gives what its rows give one by one."""
    import numpy as np

    texts = ["le chat", "", "a", "ÉÀ ß ñ", "the dog " * 50]
    logs = np.random.default_rng(1).normal(size=(len(language_id.ORDERS) << 15, 3)).astype(np.float32)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    priors = np.log([0.5, 0.2, 0.3])
    letters, best, p = language_id.score(data, offsets, logs, priors)
    for i, t in enumerate(texts):
        one = language_id.score(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), logs, priors)
        assert one[0][0] == letters[i] and (not letters[i] or (one[1][0] == best[i] and abs(one[2][0] - p[i]) < 1e-9))


def bayes_expected(labelled, texts, bits):
    """Multinomial naive Bayes over hashed n-grams, from the definition."""

    def grams(text):
        points = [ord(x) for x in "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else " " if ord(c) < 0x250 else c for c in text)]
        out = Counter()
        for order in language_id.ORDERS:
            for i in range(len(points) - order + 1):
                h = 0
                for x in points[i : i + order]:
                    h = (h * 0x01000193 ^ x * 0x9E3779B1) % (1 << 32)
                h ^= h >> 15
                out[order, (h * 0x85EBCA6B) % (1 << 32) >> (32 - bits)] += 1
        return out

    counts, rows = {}, Counter(lang for _, lang in labelled)
    for text, lang in labelled:
        counts.setdefault(lang, Counter()).update(grams(text))
    out = []
    for text in texts:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        logs = {}
        for lang, seen in counts.items():
            total = {order: sum(n for (o, _), n in seen.items() if o == order) for order in language_id.ORDERS}
            logs[lang] = math.log(rows[lang] / len(labelled)) + sum(n * math.log((seen[o, b] + 0.5) / (total[o] + 0.5 * (1 << bits))) for (o, b), n in grams(text).items())
        best = min(logs, key=lambda x: (-logs[x], x))
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


@pytest.mark.parametrize("bits", [15, 6])
def test_language_against_brute_force(spark, bits):
    words = {"en": "the of and with that is", "de": "der die und nicht schön über", "fr": "le la été où ça les"}
    rng = random.Random(4)
    labelled = [(" ".join(rng.choices(words[x].split(), k=rng.randint(1, 6))), x) for x in ("en", "en", "de", "fr", "de", "en", "en")]
    texts = [*(t for t, _ in labelled), "the die", "ÉTÉ 12", "a", "th", "", "12 !", None, "日本 the", "über alles in the world"]
    rows = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(labelled)], "doc_id bigint, text string, lang string")
    model = language_id.train(rows, bits=bits)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()}
    want = bayes_expected(labelled, texts, bits)
    assert [got[i][0] for i in range(len(texts))] == [x for x, _ in want]
    assert [got[i][1] for i in range(len(texts))] == pytest.approx([p for _, p in want], abs=1e-5)


def test_language_learns_rare_languages(spark):
    """However many labels there are, each is learned; the matrix keeps its bound."""
    rows = [(i, chr(0x4E00 + 7 * i) * 3 + " " + chr(0x4E00 + 7 * i) * 2, f"l{i:03}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(docs)
    assert len(model.langs) == 300 and model.logs.nbytes <= language_id.MATRIX_BYTES and model.bits < language_id.BUCKET_BITS
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 295


# ---- personal data ----------------------------------------------------------------------------------------
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_expected(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0

    def holds(kind, raw):
        d = re.sub("[^0-9]", "", raw)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in raw.split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()

    spans = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if holds(k, m.group(0)))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def test_pii_base_spans_and_additions(spark):
    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    texts += ["a@b.c_d@e.f x+y@z.com.. a@b.com.x@y.zz", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.003.0004", "4111 1111 1111 1111 4111-1111-1111-1111 5 4111111111111111x", "+1 (444) 555-3382 +49 30 1234567) +1", "9" * 30000, "1.1" * 5000, "+1" * 3000, "é 4111111111111111 \x01 a@b.co 😀 1.2.3.4", None, "", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6"]
    out = pii.annotate(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("base", F.lit(1)))
    rows = out.select("doc_id", pii.listed(F.col("base")).alias("base"), "added").collect()
    assert len(rows) == len(texts)
    assert all(r["base"] == base_expected(texts[r["doc_id"]]) for r in rows)
    found = [texts[r["doc_id"]][a["start"] : a["end"]] for r in rows for a in r["added"]]
    tokens = re.findall(r'token = "([0-9a-f]{40})"', "\n".join(t or "" for t in texts))
    assert set(tokens) <= set(found) and not any(x.isdigit() for x in found)


def test_pii_of_nothing(no_documents):
    assert pii.annotate(no_documents).count() == 0


def test_reliabilities_find_the_worse_labeler():
    patterns = [((1, 1, None, 1, None), 80), ((0, 0, None, 0, None), 80), ((1, 1, None, 0, None), 30), ((0, 0, None, 1, None), 30)]
    prior, rates = pii.reliabilities(patterns)
    assert 0.3 < prior < 0.7 and rates[0][0][0] > 0.85 > rates[3][0][0] and rates[0][1][0] < 0.05 < rates[3][1][0]


def test_reliabilities_against_spans_one_by_one():
    """Counting by vote pattern gives what expectation-maximisation over single spans gives."""
    rng = random.Random(3)
    patterns = [(tuple(rng.choice((1, 0, None)) for _ in pii.LABELERS), rng.randint(1, 6)) for _ in range(20)]
    spans = [v for v, n in patterns for _ in range(n)]
    prior, rates = 0.5, {(k, z, o): pii.LEAN[z][i] for k in range(len(pii.LABELERS)) for z in (0, 1) for i, o in enumerate(pii.OUTCOMES)}
    for _ in range(50):
        true = []
        for v in spans:
            t, f = prior, 1 - prior
            for k, o in enumerate(v):
                t, f = t * rates[k, 0, o], f * rates[k, 1, o]
            true.append(t / (t + f))
        lean = pii.LEAN_WEIGHT * len(spans)
        prior = (sum(true) + lean / 2) / (len(spans) + lean)
        for k in range(len(pii.LABELERS)):
            for z, w in ((0, true), (1, [1 - p for p in true])):
                for i, o in enumerate(pii.OUTCOMES):
                    rates[k, z, o] = (sum(x for x, v in zip(w, spans, strict=True) if v[k] == o) + lean * pii.LEAN[z][i]) / (sum(w) + lean)
    got_prior, got = pii.reliabilities(patterns)
    assert got_prior == pytest.approx(prior)
    assert all(got[k][z][i] == pytest.approx(rates[k, z, o]) for k in range(len(pii.LABELERS)) for z in (0, 1) for i, o in enumerate(pii.OUTCOMES))


def test_pii_finds_what_is_planted(spark):
    """Recall of each kind of secret, and what must stay."""
    rng = random.Random(8)
    some = lambda chars, n: "".join(rng.choices(chars, k=n))
    low, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secrets = {
        "hex": lambda: some(low, 40), "long hex": lambda: some(low, 128), "ghp": lambda: "ghp_" + some(alnum, 36), "live": lambda: "sk_live_" + some(alnum, 24), "slack": lambda: "xoxb-" + some("0123456789", 12) + "-" + some(alnum, 24),
        "aws": lambda: "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "base64": lambda: "7" + some(alnum + "+/", 40) + "aB==", "letters": lambda: "aB" + some(alnum[:52], 30),
    }
    plain = ["version utf-8", "chapter 12b", "see rfc-2616 there", "room4 house 7", "well-known-words here", "Donaudampfschifffahrtsgesellschaft", "in 2024-01-02 or so", "covid-19 cases", "http2 x86_64"]
    rows, planted = [], {}
    for i in range(400):
        kind = list(secrets)[i % 8]
        key = secrets[kind]()
        planted[i] = (kind, key)
        rows.append((i, f"some words {rng.choice(plain)} here {rng.choice(('token = ', 'key: ', 'secret '))}{key} and more"))
    rows += [(1000 + i, " ".join(rng.choices(plain, k=6))) for i in range(400)]
    texts = dict(rows)
    found = {r["doc_id"]: {texts[r["doc_id"]][a["start"] : a["end"]] for a in r["added"]} for r in pii.annotate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for kind in secrets:
        own = [key in found[i] for i, (k, key) in planted.items() if k == kind]
        assert sum(own) / len(own) >= 0.9, kind
    assert sum(bool(found[1000 + i]) for i in range(400)) <= 8


def test_pii_time_is_linear(spark):
    import time

    texts = ["12 x " * 200_000, "4111111111111111 x " * 5000, "a1b2c3d4e5f6 " * 20_000, "é1.2.3.4 " * 20_000]
    began = time.time()
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).select("doc_id", F.size("base").alias("n"), F.size("candidates").alias("c")).collect()
    assert time.time() - began < 60
    assert {r["doc_id"]: r["n"] for r in rows} == {0: 0, 1: 5000, 2: 0, 3: 20000} and {r["doc_id"]: r["c"] for r in rows}[2] == 20000


# ---- benchmark --------------------------------------------------------------------------------------------
def tokens(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def leaks(docs, items):
    out = {}
    for d, t in docs:
        w, hit = tokens(t), set()
        for i, text in items:
            x = tokens(text)
            n = min(13, len(x))
            need = math.ceil(0.8 * n) if len(x) >= 12 else n
            for g in range(-len(x) + 1, len(w)):
                same = [0 <= j + g < len(w) and w[j + g] == x[j] for j in range(len(x))]
                for s in range(max(0, -g), min(len(x), len(w) - g) - n + 1):
                    if n and sum(same[s : s + n]) >= need:
                        hit.add(i)
        out[d] = sorted(hit)
    return out


def test_decontaminate(spark):
    items = [(1, "The quick brown fox jumps over the lazy dog while seven small birds watch from a tall old tree"), (2, "short item of five"), (3, ""), (4, None), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (None, "one two three")]
    q = items[0][1]
    docs = [(0, "start " + q + " end"), (1, q.upper().replace("FOX", "CAT").replace("BIRDS", "mice")), (2, "quick brown fox jumps"), (3, "x Short, item of five! y"), (4, "short item of six"), (5, None), (6, ""), (7, " ".join(w if i % 3 else "zz" for i, w in enumerate(q.split()))), (8, "word " * 5000 + items[4][1]), (None, q), (9, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("start", F.lit(1)).withColumn("item_id", F.lit(1))
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in decontaminate.decontaminate(table, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = leaks(docs, [x for x in items if x[0] is not None])
    assert {d: got[d][1] for d, _ in docs if d is not None} == {d: want[d] for d, _ in docs if d is not None}
    assert got[1] == (True, [1]) and got[2] == (False, []) and got[3] == (True, [2]) and got[None] == (True, [1])


@pytest.mark.parametrize("length", [decontaminate.SPAN, decontaminate.LEAST])
def test_masks_cover_what_verification_accepts(length):
    """Every stretch of so many tokens with as many substitutions as verification accepts has a seed left."""
    ones = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    places = [{s + i for i in mask} for m, mask in zip(decontaminate.MASKS, ones, strict=True) for s in range(length - len(m) + 1)]
    most = length - math.ceil(decontaminate.SHARE * length)
    assert most == 2 and all(any(p.isdisjoint(lost) for p in places) for lost in itertools.combinations(range(length), most))


def test_decontaminate_edited_passages(spark):
    """Every placing of two substitutions in items of 12 and 13 tokens and in a part of a longer one, and random edits, against brute force."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    items = [(n, " ".join(word() for _ in range(n))) for n in (5, 7, 8, 10, 11, 12, 13, 15, 20, 40)]
    docs = []
    for n, text in items:
        w = text.split()
        at = rng.randint(0, max(0, n - 13))
        part = w[at : at + 13]
        edits = [*itertools.combinations(range(len(part)), 2)] if n in (12, 13, 40) else [rng.sample(range(len(part)), k) for k in (0, 1, 2, 3)]
        docs += [" ".join(["left", *("zz" if i in lost else x for i, x in enumerate(part)), "right"]) for lost in edits]
        docs += [" ".join(x if rng.random() > 0.2 else word() for x in w) for _ in range(20)]
    docs = list(enumerate(docs))
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == leaks(docs, items)


def test_decontaminate_long_document_of_many_items(spark):
    """A text that is benchmark throughout is cut into short rows, and every item is found, at the cuts too."""
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice((9, 12, 13, 30))))) for i in range(150)]
    long = " ".join(t for _, t in items)
    lost = " ".join("zz" if i % 7 == 0 else w for i, w in enumerate(long.split()))
    docs = spark.createDataFrame([(1, long), (2, lost)], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert {r["doc_id"]: r["item_ids"] for r in decontaminate.decontaminate(docs, bench).collect()} == leaks([(1, long), (2, lost)], items)
    regions = decontaminate.find_hits(docs, *decontaminate.seed_filter(decontaminate.prepare(bench))).collect()
    assert len(regions) > 10 and max(len(r["doc_tokens"]) // 8 for r in regions) <= decontaminate.REGION_TOKENS + 2 * decontaminate.CONTEXT + decontaminate.SPAN


def test_decontaminate_of_nothing(spark, no_documents, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(no_documents, none).count() == 0
    assert decontaminate.decontaminate(documents, none).where("contaminated").count() == 0


def test_decontaminate_whole_table(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' where length(text) < 1500").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.query(spark, SF).collect()}
    assert len(got) == 200
    inside = {d: sorted(i for i, t in items if b" ".join(tokens(t)) in b" ".join(tokens(x))) for d, x in docs}
    assert all(set(inside[d]) <= set(got[d]) for d, _ in docs) and any(inside.values())


# ---- pages ------------------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="blog">
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><div id="cookie-notice">Cookies</div>
<article><h1>Head &amp; line</h1><p><b>One%d<br><p>Two &lt;3 &#233;<i>tal</i>
 x</p><form>Mail <input></form><div class="comments"><p>First!</p></div><aside>Side</aside><ul><li>a<li>b</ul></article><footer>&copy; me</footer></body></html>"""


def test_extract(spark):
    plain = "<html><body><div>Menu always here</div><div id='c'>Story %d of today</div><div>Terms always here</div></body></html>"
    rows = [(i, "http://a.example/x", PAGE % i) for i in range(3)] + [(10 + i, f"https://b.example/{i}", plain % i) for i in range(5)]
    rows += [(20, None, None), (21, "http://c.example", ""), (22, "nonsense", "just text &amp; more"), (23, "http://a.example/odd", "<p>no article <b>here"), (23, "http://a.example/odd", "<p>no article <b>here"), (None, "http://a.example", "a < b <p>" + "w " * 50000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("slots", F.lit(1)).withColumn("host", F.lit("z")).withColumn("page", F.lit("z"))
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == "Head & line\n\nOne1\n\nTwo <3 étal x\n\na\n\nb"
    assert [by[10 + i] for i in range(5)] == [f"Story {i} of today" for i in range(5)]
    assert by[20] == "" and by[21] == "" and by[22] == "just text & more" and by[23] == "no article here"
    assert by[None].startswith("a < b\n\nw w") and len(by[None]) > 90000


def test_unclosed_parts_do_not_hide_the_article():
    _, blocks = html_extract.read_page("<body><div class='ad'>Buy<nav>Menu<article><p>Text<article class='comment'>No</article></article><footer>End")
    assert [text for _, article, text in blocks if article] == ["Text"]


def test_names_alone_drop_no_text():
    article = "<body><article><p>Start</p><section id='related-work'><p>Earlier work</p></section><section id='search'>Found</section><h2 id='search'>Search</h2><p class='share-price'>Price</p><div id='notice-period'>Three months</div><div data-id='ad'>Data</div>%s</article>"
    dropped = "<div class='comments'>No</div><div class='x ad-slot'>No</div><div id='cookie-notice'>No</div><article class='comment'>No</article><nav>No</nav>"
    hidden = "<p title='a hidden gem'>Gem</p><p class='hidden'>Class</p><p title='display:none'>Shown</p><p hidden>No</p><p HIDDEN=''>No</p><p style='color:red; display : none'>No</p>"
    _, blocks = html_extract.read_page(article % (dropped + hidden))
    assert [t for _, _, t in blocks] == ["Start", "Earlier work", "Found", "Search", "Price", "Three months", "Data", "Gem", "Class", "Shown"]
    for name in ("layout has-sidebar", "sidebar"):
        opened, blocks = html_extract.read_page(f"<body><nav>Menu</nav><div class='{name}'><p>{'All the text. ' * 20}</p><div class='ad'>Buy</div></div>")
        assert len(blocks) == 1 and blocks[0][2].startswith("All the text.") and len(opened) == 2


def test_pages_are_read_in_linear_time():
    """Unended tags, quotes that never close, deep nesting and stray end tags cost in proportion, up to 5 MB."""
    made = {
        "tags": lambda n: "<a " * n, "quotes": lambda n: "<a '\"" * n, "declarations": lambda n: "<!" * n, "ends": lambda n: "</ " * n, "scripts": lambda n: "<script " * n,
        "nested": lambda n: "<div class='x y'>a" * n, "menus": lambda n: "<nav>b" * n, "inline": lambda n: "<b>c" * n, "stray": lambda n: "<div>" * (n // 2) + "</p>" * (n // 2), "blank": lambda n: "<p a" + " " * n + ">",
    }

    def seconds(html):
        began = time.time()
        html_extract.read_page(html)
        return time.time() - began

    for name, make in made.items():
        n = 500_000 // (len(make(1000)) // 1000 or 1)
        few = max(seconds(make(n // 10)), 0.02)
        assert seconds(make(n)) < 25 * few, name
    assert seconds("<p>text <a " * 500_000) < 60


def test_malformed_pages_keep_their_text():
    shown = lambda html: [t for *_, t in html_extract.read_page(html)[1]]
    assert shown("<p>one <b>two</b> <a href='x>three</p><p title=y>four</p>") == ["one two <a href='x>three", "four"]
    assert shown('<p title="a > b">x</p><p>1 < 2 <!-- no --> 3</p><img src="' + "d" * 100_000 + '"><p>end') == ["x", "1 < 2 3", "end"]
    deep = "".join(f"<div>{i} " for i in range(2000))
    assert " ".join(shown(deep + "</div>" * 2000 + "<p>end")) == " ".join(map(str, range(2000))) + " end"
    names = "a b c d e f g".split()
    paths = html_extract.read_page("".join(f"<div class='{' '.join(names[:k])}'>x</div>" for k in range(8)) + f"<div class='main {' '.join('n' * i for i in range(40))}'>y</div>")[0]
    assert len(set(paths)) == 9 and ".main." in paths[-1] and len(paths[-1]) < 64


def test_comments_and_adverts_in_articles():
    parts = "<div class='user-comment'>No</div><ol class='commentlist'><li>No</ol><p class='advertisement'>No</p><div class='ad-300x250 promo-box-big'>No</div><div class='ad-300x250'>No</div><p class='share-price'>Price</p>"
    assert [t for *_, t in html_extract.read_page(f"<body><article><p>Text</p>{parts}<p>End</p></article>")[1]] == ["Text", "Price", "End"]


def test_template_texts_in_articles(spark):
    """An unnamed notice of every page goes inside main as well; copies of one article stay whole, and so do texts of some pages."""
    page = "<body><nav>Menu</nav><main><p>We use many partners</p><h1>Story %d</h1><p>%s</p><div class='x'><p>Call us today</p></div></main></body>"
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(i, "http://a.example/", page % (i, f"Told {i}: {words}" if i % 2 else f"Shared by half: {words}")) for i in range(6)]
    rows += [(10 + i, "http://copies.example/", page % (1, f"{words}</p><p>Copy {i}")) for i in range(5)] + [(20 + i, "http://few.example/", page % (i, words)) for i in range(3)]
    rows += [(30, "http://a.example/lacks", "<body><p>No main here</p></body>")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"Story {i}\n\n" + (f"Told {i}: {words}" if i % 2 else f"Shared by half: {words}") for i in range(6))
    assert all(got[10 + i] == f"We use many partners\n\nStory 1\n\n{words}\n\nCopy {i}\n\nCall us today" for i in range(5))
    assert all(got[20 + i] == f"We use many partners\n\nStory {i}\n\n{words}\n\nCall us today" for i in range(3))
    assert got[30] == "No main here"


def test_repeated_pages_and_wrappers(spark):
    """Repeated rows count once; a text under half of a host's urls is no template; forms and open menus may wrap a page."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    plain = "<body><div class='top'>Site name</div><div class='text'><p>%s</p></div><div class='low'>Imprint</div></body>"
    rows = [(i, f"http://twice.example/{i}", plain % f"Page {i % 2}: {words}") for i in range(4)] + [(None, "http://twice.example/", plain % f"Page 0: {words}")]
    rows += [(10 + i, f"http://half.example/{i}", plain % (f"Syndicated: {words}</p><p>More of it: {words}" if i % 2 else f"Own {i}: {words}")) for i in range(8)]
    rows += [(30, "http://form.example/", f"<body><form id='aspnetForm'><div><p>{words}</p></div><nav>Menu</nav></form></body>"), (31, "http://open.example/", f"<body><nav><ul><li>Menu</ul><p>{words} {words}</p></body>")]
    rows += [(32, "http://long.example/", f"<body><article><p>Short</p></article><footer>{words} {words}</footer></body>")]
    rows += [(40 + i, f"http://two.example/{i}", f"<body><main><p>Intro {i}</p></main><div><p>Aside of all pages</p></div><main><p>Rest {i}</p></main></body>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(f"Page {i % 2}: {words}" in got[i] for i in range(4)) and f"Page 0: {words}" in got[None]
    assert all(got[10 + i] == (f"Syndicated: {words}\n\nMore of it: {words}" if i % 2 else f"Own {i}: {words}") for i in range(8))
    assert words in got[30] and "Menu" not in got[30] and words in got[31] and got[32] == "Short"
    assert all(got[40 + i] == f"Intro {i}\n\nRest {i}" for i in range(6))


def test_classes_against_brute_force(spark):
    """Fixed texts of a host are those that occur exactly as often, page by page, as some container around them."""
    rng = random.Random(2)
    pages = []
    for i in range(12):
        parts = ["<div class='head'><p>Fixed head</p></div>"]
        if i % 3:
            parts.append("<div class='third'><p>Two of three</p></div>")
        parts += [f"<div class='item'><p>Label</p><p>{rng.random()} {'word ' * 20}</p></div>" for _ in range(1 + i % 4)]
        if i % 2:
            parts.append("<p>On odd pages</p>")
        pages.append(f"<body><div class='all'>{''.join(parts)}</div></body>")
    rows = spark.createDataFrame([(i, "http://a.example/", h) for i, h in enumerate(pages)], "page_id bigint, url string, html string")
    template = html_extract.templates(html_extract.with_host(rows)).first()
    vectors, texts = {}, {}
    for i, h in enumerate(pages):
        opened, blocks = html_extract.read_page(h)
        for path in ["", *opened]:
            vectors.setdefault(path, Counter())[i] += 1
        for paths, _, text in blocks:
            texts.setdefault((paths[-1], text), Counter())[i] += 1
    want = {html_extract._text_key(p, t) for (p, t), seen in texts.items() if len(seen) >= 6 and any(vectors[x] == seen for x in vectors if p == x or p.startswith(x + "/") or x == "")}
    assert set(template["boilerplate"]) == want and len(want) == 3


def test_extract_of_nothing(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_extract_articles_of_the_table(spark):
    pages = {p: h for p, h in duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall()}
    from html import unescape

    for r in html_extract.query(spark, SF).collect():
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:h1|p)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# ---- urls -------------------------------------------------------------------------------------------------
def test_url_filter(spark):
    entries = [("bad.example", "add", "2024-01-10"), ("bad.example", "add", "2024-01-12"), ("bad.example", "drop", "2024-02-01"), ("bad.example", "add", "2024-03-01"), ("Ok.example/spam/x", "add", "2024-01-01"), ("x.org", "add", "2024-01-05"), ("x.org", "drop", "2024-01-05"), (None, "add", "2024-01-01"), ("y.org", "noise", "2024-01-01")]
    captures = [(1, "http://www.BAD.example/a", "2024-01-09"), (2, "http://www.bad.example/a", "2024-01-10"), (3, "https://u@bad.example:8080", "2024-02-01"), (4, "http://bad.example.", "2024-05-01"), (5, "http://notbad.example", "2024-05-01"), (6, "http://ok.example/spam/x/y?z", "2024-05-01"), (7, "http://ok.example/spam", "2024-05-01"), (8, "http://x.org", "2024-05-01"), (9, None, "2024-05-01"), (10, "http://bad.example", None), (11, "nonsense", "2024-05-01"), (2, "http://www.bad.example/a", "2024-01-10")]
    e = spark.createDataFrame(entries, "pattern string, action string, at string").withColumn("at", F.to_timestamp_ntz("at"))
    c = spark.createDataFrame(captures, "page_id bigint, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp_ntz("fetched_at")).withColumn("pattern", F.lit("z"))
    rows = url_filter.filter_urls(c, e).collect()
    assert len(rows) == len(captures) and {r["page_id"]: r["pattern"] for r in rows if r["blocked"]} == {2: "bad.example", 4: "bad.example", 6: "ok.example/spam/x"}
    assert url_filter.filter_urls(c, e.limit(0)).where("blocked").count() == 0 and url_filter.filter_urls(c.limit(0), e).count() == 0
    deep = spark.createDataFrame([("ok.example/spam/x/y/a/b/c", "add")], "pattern string, action string").withColumn("at", F.to_timestamp_ntz(F.lit("2024-01-01")))
    far = spark.createDataFrame([(1, "http://www.ok.example/spam/x/y/a/b/c/d?e"), (2, "http://ok.example/spam/x/y/a/b")], "page_id bigint, url string").withColumn("fetched_at", F.to_timestamp_ntz(F.lit("2024-02-01")))
    assert {r["page_id"]: r["blocked"] for r in url_filter.filter_urls(far, deep).collect()} == {1: True, 2: False}


# ---- mixing -----------------------------------------------------------------------------------------------
def mix_expected(sizes):
    """{source: target} by repeated sharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        left, weights = total - sum(full.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / weights >= 2 * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / weights for s in rest}
        full |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100}, {"a": 1000, "b": 10, "c": 5, None: 50}, {"a": 10, "b": 1000, "c": 1000, "d": 3, "é": 7, "B": 0}, {"x": 5, None: 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in curriculum.targets(df).collect()}
    assert got == pytest.approx(mix_expected(sizes))


def test_curriculum(spark, documents, corpus):
    source = lambda d: ("s1", "s1", "s2", None, "S")[d % 5]
    size = {d: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in corpus}
    sums = {}
    for d in size:
        sums[source(d)] = sums.get(source(d), 0) + size[d]
    want = mix_expected(sums)
    rows = curriculum.curriculum(documents).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(size)
    taken = {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(size[d] for d in size if source(d) == s) for s in want)
    assert sorted(rows) == sorted(curriculum.curriculum(documents.repartition(7)).collect())
    order = curriculum.training_order(curriculum.curriculum(documents)).collect()
    assert len(order) == sum(r["copies"] for r in rows) and [r["position"] for r in order] == sorted(r["position"] for r in order)


def test_demand_is_inverted(spark):
    for start in (0.5, 1.0, 1.5, 0.0, 2.0):
        df = spark.range(0, 101).select((F.col("id") / 100).alias("share"))
        for r in df.select("share", curriculum.inverse_demand(F.col("share"), F.lit(start)).alias("t")).collect():
            assert start * r["t"] + (1 - start) * r["t"] ** 2 == pytest.approx(r["share"], abs=1e-9)


def test_curriculum_of_nothing(no_documents):
    assert curriculum.curriculum(no_documents).count() == 0


# ---- entry ------------------------------------------------------------------------------------------------
def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
