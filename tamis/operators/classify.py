"""Nearest anchor text by TF-IDF cosine over character n-grams within words, with a reject class.

The model has 33 anchors and under 2,000 n-grams, so it is fitted on the driver, and tasks have it whole. A text is
scored in the row where it stands, by an Arrow function that counts the model's n-grams in its words.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis import fixed
from tamis.config import DEFAULT, Config
from tamis.functions.text import FOLD_FROM, FOLD_LONG, FOLD_TO, fold_accents, let, strip

#: Characters that are looked at together.
PIECE = 1 << 20
#: Codes of characters that fold to nothing and to several.
GONE, SEVERAL = 255, 254
#: Marks of Unicode 14 and later, which Spark's Java does not know as such, and one that has since become a spacing one.
_NOT_MARKS = ((0x898, 0x89F), (0x8CA, 0x8D2), (0xC3C, 0xC3C), (0xECE, 0xECE), (0x180F, 0x180F), (0x1AC1, 0x1ACE), (0x1DFA, 0x1DFA), (0x10EFD, 0x10EFF), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x11073, 0x11074), (0x110C2, 0x110C2), (0x11241, 0x11241), (0x11F00, 0x11F01), (0x11F36, 0x11F3A), (0x11F40, 0x11F40), (0x11F42, 0x11F42), (0x13440, 0x13440), (0x13447, 0x13455), (0x1CF00, 0x1CF2D), (0x1CF30, 0x1CF46), (0x1E08F, 0x1E08F), (0x1E2AE, 0x1E2AE), (0x1E4EC, 0x1E4EF))
_MARK = "\u1734"
LABELS = tuple(sorted({label for label, _ in fixed.ANCHORS}))


def char_grams(word: str, low: int, high: int) -> list[str]:
    """n-grams of a word with a space at either end; a word shorter than n gives none of that length."""
    w = f" {word} "
    return [w[i : i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1)]


@cache
def fit(low: int = DEFAULT.nlp_ngram_min, high: int = DEFAULT.nlp_ngram_max) -> tuple[dict[str, float], list[dict[str, float]]]:
    """(idf of each n-gram, weights of each anchor): smooth idf, sublinear counts, rows of length one."""
    counts = [Counter(g for word in text.split() for g in char_grams(word, low, high)) for _, text in fixed.ANCHORS]
    seen = Counter(g for c in counts for g in c)
    idf = {g: math.log((1 + len(counts)) / (1 + n)) + 1 for g, n in seen.items()}
    rows = [{g: (1 + math.log(n)) * idf[g] for g, n in c.items()} for c in counts]
    norms = [math.sqrt(sum(w * w for w in row.values())) for row in rows]
    return idf, [{g: w / norm for g, w in row.items()} for row, norm in zip(rows, norms, strict=True)]


def vocabulary(spark: SparkSession, config: Config = DEFAULT) -> DataFrame:
    """(gram, idf, weights array<double> by anchor); its size is fixed by the anchors."""
    idf, rows = fit(config.nlp_ngram_min, config.nlp_ngram_max)
    return spark.createDataFrame([(g, idf[g], [row.get(g, 0.0) for row in rows]) for g in sorted(idf)], "gram string, idf double, weights array<double>")


def words_of(text: Column) -> Column:
    return F.filter(F.split(folded(text), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def with_grams(words: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rows of (word, ...) once for each n-gram of the word, as gram: cut place by place, which Spark compiles, where lambdas are interpreted."""
    low, high = config.nlp_ngram_min, config.nlp_ngram_max
    kept = [c for c in words.columns if c != "word"]
    padded = words.select(*kept, F.concat(F.lit(" "), "word", F.lit(" ")).alias("_w")).where(F.length("_w") >= low)
    places = padded.select(*kept, "_w", F.explode(F.sequence(F.lit(1), F.length("_w") - (low - 1))).alias("_i"))
    cut = [F.when(F.col("_i") + (n - 1) <= F.length("_w"), F.substring("_w", F.col("_i"), F.lit(n))) for n in range(low, high + 1)]
    return places.select(*kept, F.explode(F.array(*cut)).alias("gram")).where("gram is not null")


def char_gram_array(word: Column, config: Config = DEFAULT) -> Column:
    """array<string> of a word's n-grams, one for each place: for use in a row, where ``with_grams`` makes rows."""

    def cut(w: Column) -> Column:
        of = lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))
        some = [F.when(F.length(w) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in range(config.nlp_ngram_min, config.nlp_ngram_max + 1)]
        return F.concat(*some)

    return let(F.concat(F.lit(" "), word, F.lit(" ")), cut)


@cache
def _codes(low: int, high: int) -> dict[str, int]:
    """The characters of the model's n-grams by number, the space first."""
    return {c: i for i, c in enumerate(sorted(set("".join(fit(low, high)[0]))), 1)}


@cache
def _fold_table() -> dict[int, str]:
    """What ``folded`` makes of each character that it changes."""
    not_marks = {c for a, b in _NOT_MARKS for c in range(a, b + 1)}
    marks = {c for c in range(0x110000) if unicodedata.category(chr(c)) == "Mn"} - not_marks | {ord(_MARK)}
    one, out = dict(zip(map(ord, FOLD_FROM), FOLD_TO, strict=True)), {}
    for c in range(0x80, 0x110000):
        if c in marks:
            out[c] = ""
        elif c < 0x2000 or c in (0x212A, 0x212B) or chr(c) in FOLD_LONG:
            low = "".join(FOLD_LONG.get(x, x) for x in chr(c).lower()).translate(one)
            out[c] = "".join(x for x in low if ord(x) not in marks)
    return out | {c: chr(c).lower() for c in range(0x80)}


@cache
def _code_table(low: int, high: int, raw: bool) -> np.ndarray:
    """The code of every character, of all white space that of the space; of raw texts, the code of what the character folds to."""
    code, table = _codes(low, high), np.zeros(0x110000, np.uint8)
    of = lambda c: code[" "] if c.isspace() else code.get(c, 0)
    spaces = [c for c in range(0x3001) if chr(c).isspace()]
    table[spaces] = code[" "]
    table[[ord(c) for c in code]] = list(code.values())
    for c, to in _fold_table().items() if raw else ():
        table[c] = GONE if not to else of(to) if len(to) == 1 else SEVERAL
    return table


def _line(text: str, low: int, high: int, raw: bool) -> np.ndarray:
    """Codes of a text's words, one space before, between and after them."""
    table = _code_table(low, high, raw)
    codes = table[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    if raw and len(codes) and codes.max() >= SEVERAL:
        if (codes == SEVERAL).any():
            folded = _fold_table()
            text = "".join(folded.get(ord(c), c) for c in text)
            codes = _code_table(low, high, False)[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        codes = codes[codes != GONE]
    space = np.uint8(_codes(low, high)[" "])
    line = np.concatenate(([space], codes, [space])).astype(np.uint8)
    return line[np.concatenate(([True], (line[1:] != space) | (line[:-1] != space)))]


@cache
def _known(low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The model's n-grams as a tree: (node of each run of as many codes as the shortest n-gram or three, next node by node and code, node of each n-gram, its idf, its weight in each anchor).

    Node 0 is none, node 1 the root, and code 0 a character that no n-gram has.
    """
    idf, rows = fit(low, high)
    grams = sorted(idf)
    code = _codes(low, high)
    node = {"": 1} | {p: i for i, p in enumerate(sorted({g[:n] for g in grams for n in range(1, len(g) + 1)}), 2)}
    after = np.zeros((len(node) + 1, len(code) + 1), np.int32)
    for p, i in node.items():
        if p:
            after[node[p[:-1]], code[p[-1]]] = i
    first = after[1]
    for _ in range(min(low, 3) - 1):
        first = after[first].ravel()
    return first, after, np.array([node[g] for g in grams]), np.array([idf[g] for g in grams]), np.array([[row.get(g, 0.0) for row in rows] for g in grams])


def _counts(text: str, low: int, high: int, raw: bool = False) -> np.ndarray:
    """How often each n-gram of the model stands in the words of a text, folded or raw: from every place at once, a character further while some n-gram begins so."""
    first, after, nodes, *_ = _known(low, high)
    found, start = np.zeros(len(after), np.int64), min(low, 3)
    # n-grams have spaces at their ends only, so none spans two words
    line = _line(text, low, high, raw)
    for head in range(0, len(line), PIECE):
        # the first characters of all places are looked up together
        size = min(PIECE, len(line) - start + 1 - head)
        if size <= 0:
            break
        key = line[head : head + size].astype(np.int32)
        for n in range(1, start):
            key *= after.shape[1]
            key += line[head + n : head + n + size]
        node = first[key]
        at = node.nonzero()[0]
        at, node = at + head, node[at]
        for n in range(start, high + 1):
            if n > start:
                inside = np.searchsorted(at, len(line) - n, "right")
                at = at[:inside]
                node = after[node[:inside], line[at + (n - 1)]]
                live = node > 0
                at, node = at[live], node[live]
            if n >= low:
                found += np.bincount(node, minlength=len(found))
    return found[nodes]


def cosines_of(low: int = DEFAULT.nlp_ngram_min, high: int = DEFAULT.nlp_ngram_max, raw: bool = False) -> Callable[..., Column]:
    """A function of folded text, or of raw text that it folds itself: its cosines with the anchors, null where it shares no n-gram with them or is null.

    Only n-grams of the model are counted, so a text takes time by its length, and nothing is shuffled. A task holds a batch of texts.
    """

    def of(text: str | None) -> list[float] | None:
        *_, idf, weights = _known(low, high)
        counts = _counts(text or "", low, high, raw)
        at = counts.nonzero()[0]
        if not len(at):
            return None
        q = (1 + np.log(counts[at])) * idf[at]
        # summed row by row, so anchors of equal weights have equal sums
        return ((q[:, None] * weights[at]).sum(axis=0) / math.sqrt(q @ q)).tolist()

    return F.arrow_udf(lambda texts: pa.array([of(t.as_py()) for t in texts], pa.list_(pa.float64())), "array<double>")


def ranked(cosines: Column) -> Column:
    """array<struct<score, label>>: the best anchor of each label, by score, then label. Null cosines score 0."""

    def best(label: str) -> Column:
        own = [F.get(cosines, F.lit(k)) for k, (name, _) in enumerate(fixed.ANCHORS) if name == label]
        return F.struct((-F.coalesce(F.greatest(*own), F.lit(0.0))).alias("minus"), F.lit(label).alias("label"))

    return F.transform(F.array_sort(F.array(*map(best, LABELS))), lambda x: F.struct((-x["minus"]).alias("score"), x["label"].alias("label")))


def decide(text: Column, order: Column, config: Config = DEFAULT) -> Column:
    """struct<symptom, confidence, runner_ups array<struct<symptom, score>>>."""
    return let(order, lambda ranks: _decide(text, ranks, config))


def _decide(text: Column, order: Column, config: Config) -> Column:
    short = text.isNull() | (F.length(strip(text)) < config.nlp_min_text_length)
    top = F.get(order, F.lit(0))
    known = (top["label"] != fixed.UNKNOWN) & (top["score"] >= config.nlp_threshold)
    rest = F.transform(F.slice(order, 2, len(LABELS)), lambda x: F.struct(x["label"].alias("symptom"), F.bround(x["score"], 4).alias("score")))
    return F.struct(
        F.when(short, fixed.TOO_SHORT).when(known, top["label"]).otherwise(fixed.UNKNOWN).alias("symptom"),
        F.when(short, 0.0).otherwise(F.bround(top["score"], 4)).alias("confidence"),
        F.when(short, F.array().cast("array<struct<symptom:string,score:double>>")).otherwise(rest).alias("runner_ups"),
    )


def folded(text: Column) -> Column:
    """Lower case without accents, as the anchors are."""
    return let(F.lower(text), lambda low: F.when(F.octet_length(low) == F.length(low), low).otherwise(fold_accents(low)))


def infer(texts: DataFrame, key: str = "ticket_id", text: str = "masked", config: Config = DEFAULT) -> DataFrame:
    """texts with ``inference``, each row by its own text where it stands, so keys may be repeated or missing."""
    long = F.when(F.length(strip(F.col(text))) >= config.nlp_min_text_length, F.col(text))
    out = texts.withColumn("_cosines", cosines_of(config.nlp_ngram_min, config.nlp_ngram_max, raw=True)(long))
    return out.withColumn("inference", decide(F.col(text), ranked(F.col("_cosines")), config)).drop("_cosines")


def infer_distinct(texts: DataFrame, text: str = "masked", config: Config = DEFAULT) -> DataFrame:
    """texts with ``inference``, each different text classified once: for streams of tickets that repeat bodies."""
    once = texts.select(F.col(text).alias("_text")).where("_text is not null").distinct().withColumn("_key", F.sha2("_text", 256))
    found = infer(once, "_key", "_text", config).select("_text", "inference")
    empty = decide(F.lit(None).cast("string"), ranked(F.lit(None).cast("array<double>")), config)
    return texts.join(found, F.col(text) == F.col("_text"), "left").withColumn("inference", F.coalesce("inference", empty)).drop("_text")


def label_and_score(inference: Column) -> Column:
    return F.struct(inference["symptom"].alias("label"), inference["confidence"].alias("score"))


def parse_symptom(value: Column) -> Column:
    return F.when(value.isin(*fixed.SYMPTOM_LABELS), value).otherwise(fixed.UNKNOWN)
