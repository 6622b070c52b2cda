import random

import pytest


def sentences(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, edited copies, shared passages, repeats inside a text, and odd texts."""
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("the", "on", "ré", "schö", "ing") for b in ("ar", "el", "um", "is") for c in ("a", "e", "tion", "ñ", "x1")]
    passage = sentences(rng, 80, words)
    docs = [sentences(rng, rng.randint(1, 160), words) for _ in range(25)]
    docs += docs[:4] + docs[:2] + [d.upper() for d in docs[4:6]]
    for d in docs[6:12]:
        w = d.split()
        w[len(w) // 2] = "edited"
        docs.append(" ".join(w))
    docs += [docs[12][:300] + " " + passage + " " + docs[13][:200], passage, passage + " " + passage, sentences(rng, 30, words) + "\n" + passage]
    docs += ["", None, " \t\n", "one", "two words", "ab " * 400, "x" * 5000, "7" * 300 + " " + "7" * 300, "é" * 250, "１２３ !!!", "123 456", "a b c d e f", sentences(rng, 6000, words)]
    return list(enumerate(docs))


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with extra columns whose names clash with those that operators use."""
    rows = [(d, t, ("en", "de", None)[d % 3], ("s1", "s1", "s2", None, "S")[d % 5], d, "x", d) for d, t in corpus]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, size bigint, spans string, node bigint").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
