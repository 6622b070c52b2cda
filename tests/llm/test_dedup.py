import hashlib
import random
import re
import string
from collections import Counter

from pyspark.sql import functions as F

from tamis.llm import exact_dedup, minhash, substring_dedup, suffix_dedup
from tamis.llm.common import drop_stored, scratch_path, stored, sweep
from tamis.llm.components import components


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# ---- exact ------------------------------------------------------------------------------------------------
def exact_expected(corpus, best):
    groups = {}
    for d, t in corpus:
        groups.setdefault(t or "", []).append(d)
    return {d: (best(g), len(g), d == best(g)) for g in groups.values() for d in g}


def test_exact(documents, corpus, no_documents):
    for keep, best in (("max", max), ("min", min)):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(documents, keep=keep).collect()}
        assert got == exact_expected(corpus, best)
    assert exact_dedup.dedup(no_documents).count() == 0


def test_exact_digests_that_clash(documents, corpus):
    weak = lambda text: F.unhex(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 1))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(documents, keep="max", digest=weak).collect()}
    assert got == exact_expected(corpus, max)


def test_exact_repeated_and_null_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, None), (3, "")], "doc_id bigint, text string")
    got = sorted(((str(r["doc_id"]), r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(docs, keep="max").collect()), key=str)
    assert got == [("1", 1, 3), ("1", 1, 3), ("2", 3, 2), ("3", 3, 2), ("None", 1, 3), ("None", None, 1)]


def test_exact_later_batch_meets_earlier_run(spark, documents):
    earlier = documents.where("doc_id < 20")
    first = exact_dedup.flush(earlier, scratch_path(spark, "run"))
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.dedup(documents.where("doc_id between 25 and 30"), keep="min", runs=[first], history=earlier).collect()}
    assert got == {25: 0, 26: 1, 27: 2, 28: 3, 29: 0, 30: 1}


def test_exact_earlier_run_with_digests_that_clash(spark):
    """Earlier texts take part in the groups where digests of different texts are equal, too."""
    weak = lambda text: F.unhex(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 1))
    make = lambda first: spark.createDataFrame([(first + i, f"text {i}") for i in range(300)], "doc_id bigint, text string")
    earlier = make(0)
    run = exact_dedup.flush(earlier, scratch_path(spark, "run"), weak)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(make(1000), runs=[run], digest=weak, history=earlier).collect()}
    assert got == {1000 + i: (i, 2, False) for i in range(300)}


# ---- bytes ------------------------------------------------------------------------------------------------
def suffix_expected(corpus, width):
    texts = {d: (t or "").encode() for d, t in corpus}
    seen = Counter(b[i : i + width] for b in texts.values() for i in range(len(b) - width + 1))
    out = {}
    for d, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), kept)
    return out


def test_suffix(documents, corpus, no_documents):
    for width, gram in ((200, 100), (40, 16), (33, 33)):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.keep(suffix_dedup.repeated(documents, width, gram), width).collect()}
        assert got == suffix_expected(corpus, width)
    assert suffix_dedup.keep(suffix_dedup.repeated(no_documents)).count() == 0


def test_suffix_of_odd_rows(spark):
    """Null and repeated identifiers: every row is a document of its own; identifiers of more than 53 bits stay whole."""
    rng = random.Random(9)
    make = lambda n: "".join(rng.choices(string.ascii_letters, k=n))
    shared, big = make(260), (1 << 60) + 1
    rows = [(1, make(300) + shared), (1, make(50) + shared + make(10)), (None, shared + make(400)), (None, make(30)), (0, make(20) + shared[:220]), (big, make(500)), (big, make(100) + shared[20:]), (7, None), (7, "x")]
    for some in (rows, [(big - i, t) for i, (_, t) in enumerate(rows)]):
        out = suffix_dedup.keep(suffix_dedup.repeated(spark.createDataFrame(some, "doc_id bigint, text string"))).collect()
        want = suffix_expected(list(enumerate(t for _, t in some)), 200)
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out)
        assert got == sorted((str(some[i][0]), *x) for i, x in want.items())
        assert sum(x[1] for x in want.values()) > 1000


# ---- words ------------------------------------------------------------------------------------------------
def substring_expected(corpus, width):
    first, out = {}, {}
    for d, t in sorted(corpus):
        w = split(t)
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    for d, t in corpus:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())
    return out


def test_substring(documents, corpus, no_documents):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substring_dedup.dedup_batch(documents)[0].collect()}
    assert got == substring_expected(corpus, 50)
    assert substring_dedup.dedup_batch(no_documents)[0].count() == 0


def test_substring_in_batches_with_compaction(spark, documents, corpus):
    index, got, history = [], {}, None
    for low, high in ((0, 15), (15, 33), (33, 99)):
        batch = documents.where(f"doc_id >= {low} and doc_id < {high}")
        out, index = substring_dedup.dedup_batch(batch, history, index, width=12, gram=5)
        got |= {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in out.collect()}
        index = [substring_dedup.compact(spark, index, scratch_path(spark, "merged"))]
        history = batch if history is None else history.unionByName(batch)
    assert got == substring_expected(corpus, 12)


def test_substring_of_whole_tables(spark, documents, corpus, no_documents):
    for batches in (1, 2, 4):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substring_dedup.dedup(documents, batches, 12, 5).collect()}
        assert got == substring_expected(corpus, 12)
    assert substring_dedup.dedup(no_documents).count() == 0


def test_substring_of_odd_rows(spark):
    """Rows of one doc_id start the windows of all of them and are cut each by its own text; null identifiers take no part."""
    rng = random.Random(9)
    make = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b = make(30), make(30)
    rows = [(1, a + " " + make(20)), (1, b), (2, make(3) + " " + b + " " + make(9)), (2, make(40)), (3, a), (None, a), (None, make(5)), (None, None), (3, "")]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, 12, 5).collect())
    assert got == sorted([("1", 50, 0), ("1", 30, 0), ("2", 42, 30), ("2", 40, 0), ("3", 30, 30), ("None", 30, 0), ("None", 5, 0), ("None", 0, 0), ("3", 0, 0)])


# ---- near copies ------------------------------------------------------------------------------------------
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def minhash_expected(corpus):
    sets = {}
    for d, t in corpus:
        w = split((t or "").translate(LOW))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def family(n, rate, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    texts = [[rng.choice(words) for _ in range(120)]]
    for i in range(n):
        source = texts[0] if i % 2 else texts[rng.randrange(len(texts))]
        texts.append([rng.choice(words) if rng.random() < rate else w for w in source])
    return [" ".join(t) for t in texts]


def test_minhash(spark, documents, corpus):
    more = [(1000 + i, t) for i, t in enumerate(family(60, 0.02, 1) + family(60, 0.035, 2))]
    random.Random(1).shuffle(more)
    both = documents.select("doc_id", "text", "node", "spans").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.cluster(both).collect()}
    assert got == minhash_expected(corpus + more)


def test_minhash_rows_of_one_identifier(spark):
    """Each text of a doc_id has its own links; repeated rows are one node; null ids link with nothing."""
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    rows = [(5, a), (5, b), (5, b), (3, a + " x"), (9, b + " y"), (None, a), (None, None), (7, "")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.cluster(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(5, 46, 3, False), (5, 46, 5, True), (5, 46, 5, True), (3, 47, 3, True), (9, 47, 5, False), (None, 46, None, True), (None, 0, None, True), (7, 0, 7, True)], key=str)


def test_minhash_template_documents(spark):
    """Documents of one template that are less similar than the threshold meet no partner at its shingles."""
    rng = random.Random(6)
    shared = " ".join(f"t{i}" for i in range(120))
    docs = [(i, shared + " " + " ".join(f"o{i}x{j}" for j in range(33 + rng.randint(0, 4)))) for i in range(60)]
    docs += [(100 + i, docs[i][1] + " tail") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.cluster(df).collect()}
    assert got == minhash_expected(docs)


def test_minhash_beyond_what_may_be_broadcast(spark, documents, corpus, monkeypatch):
    """Larger key tables are shuffled, with the same result."""
    from tamis.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.cluster(documents).collect()}
    assert got == minhash_expected(corpus)


def test_minhash_of_nothing(no_documents):
    assert minhash.cluster(no_documents).count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (300, 300), (None, 1)]
    random.Random(2).shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}


# ---- scratch tables ---------------------------------------------------------------------------------------
def test_scratch_tables(spark):
    one, two = stored(spark.range(3), "one"), stored(spark.range(0), "none")
    assert one.count() == 3 and two.count() == 0
    path = one.inputFiles()[0].rsplit("/", 1)[0]
    drop_stored(one, two)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files)
    three = stored(spark.range(2), "three").inputFiles()[0]
    sweep(spark)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(three)
    assert not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files)
