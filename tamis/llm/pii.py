"""Personal data by fixed patterns and weakly supervised labelers.

Base spans (email, ip, card, phone) are fixed patterns with checks. The method adds spans of kind ``account``:
user names, keys, tokens and other secrets that identify an account.

1. ``find`` reads every whole text once: base spans and candidate spans, runs of eight or more key characters with
   letters and digits (or of twenty or more in mixed case), of any length, with the labelers' votes: regex (shape of
   a key), gazetteer (prefixes of issued keys, and of well-known other names), context (a cue word before, or
   punctuation that makes it part of something else), mix (changes between letters and digits) and base (overlaps a
   base span). A vote is 1, 0 or null (abstains).
2. ``reliabilities``: candidates are counted by vote pattern, at most 3^5 rows, and expectation-maximisation on
   these counts gives the prior and, for true and for false spans, each labeler's rates of 1, 0 and abstaining. An
   abstention is an outcome like others, so a labeler that only ever votes one way tells something too. A tenth of
   the weight of the candidates is put on rates by which a vote means what it says, whatever the corpus.
3. ``train``: the posteriors are soft labels of a naive Bayes classifier over span features that no labeler
   sees alone (length, letter case, share of digits, character before, cue, prefix); its weights are one row a feature
   value. Spans with log odds above 0 that overlap no base span are added.

Null text counts as empty; empty texts have no spans; a repeated or null doc_id is a row of its own; extra
columns are ignored; empty tables give no rows, and no candidates no added spans. Offsets are code points, end
exclusive. Patterns run in time linear in the text's length, and places of matches are summed by blocks. What each
labeler sees of the context ends at the candidate before. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.text import let, marked_spans
from tamis.llm.common import stored, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Runs start only where a run can start (after a match, or not inside a run of the same
#: characters) and are possessive: neither changes a match, both keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # shorter numbers never pass, and no part of one has more digits than the whole
    "card": r"(?=(?:[0-9][\x20-]?){11}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = (
    r"(?<![A-Za-z0-9_+/-])(?:(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])"
    r"|(?=[A-Za-z_+/-]{20})(?=[A-Z_+/-]*+[a-z][a-z_+/-]*+[A-Z]))[A-Za-z0-9_+/-]{8,}+={0,2}"
)
CUES = r"(?i)(?:password|passwd|pwd|token|secret|key|user|login|account|api)[\x20]{0,2}[:=]?[\x20]{0,2}[\x22\x27]?$"
#: Prefixes of issued keys, and of names that are none; fixed values.
PREFIXES = r"^(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|[spr]k_(?:live|test)_|npm_|pypi-|hf_|dop_v1_|eyJ)[A-Za-z0-9_+/-]{12,}=*$"
NO_KEYS = r"(?i)^(?:utf|iso|rfc|cve|isbn|issn|doi|din|sha|md5|x86|ipv|www|http|covid)[_/+-]?[0-9]"
LABELERS = ("regex", "gazetteer", "context", "mix", "base")
FEATURES = ("length", "case", "digits", "before", "cue", "prefix")
MARK, OTHER = "\u0001", "\u0002"
FOUND = "array<struct<start:int,no:int,end:int,kind:string,raw:string>>"


def parts_of(text: Column, pattern: str) -> Column:
    """text, which must hold no MARK, split around the pattern's leftmost matches, which are every second part."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)


def luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((F.length(digits) - i) % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def valid(span: Column) -> Column:
    raw = span["raw"]
    digits = F.regexp_replace(raw, "[^0-9]", "")
    parts = F.transform(F.split(raw, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))
    card = F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    phone = F.length(digits).between(9, 15)
    return F.when(span["kind"] == "ip", ip).when(span["kind"] == "card", card).when(span["kind"] == "phone", phone).otherwise(True)


def base_spans(text: Column) -> Column:
    """Valid base spans of a text without MARK, by start, then kind as listed."""
    able = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": F.contains(text, F.lit("+"))}
    kinds = [F.struct(F.lit(i).alias("no"), F.lit(k).alias("kind"), F.when(able[k], parts_of(text, PATTERNS[k])).otherwise(F.array().cast("array<string>")).alias("parts")) for i, k in enumerate(KINDS)]
    named = lambda k: F.transform(marked_spans(k["parts"]), lambda s: F.struct(s["start"], k["no"], s["end"], k["kind"], s["raw"]))
    return F.array_sort(F.filter(F.flatten(F.transform(F.array(*kinds), named)).cast(FOUND), valid))


def candidates(text: Column, base: Column) -> Column:
    """Candidate spans with votes and features."""

    def judged(c: Column, around: Column) -> Column:
        raw, start, end = c["raw"], c["start"], c["end"]
        before, after = around["before"], around["after"]
        near = F.right(before, F.lit(1))  # the character before
        cue = before.rlike(CUES)
        size, n_digits = end - start, F.length(F.regexp_replace(raw, "[^0-9]", ""))
        turns = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "[0-9]+", "9"), "[A-Za-z]+", "a"), "[^9a]+", "")) - 1
        hit = F.exists(base, lambda b: (b["start"] < end) & (start < b["end"]))
        key = raw.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|[A-Z0-9]{16,})$|^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_+/-]{20,}=*$")
        vote = lambda yes, no: F.when(yes, 1).when(no, 0)
        votes = (
            vote(key, raw.rlike("^[0-9]+[A-Za-z]{1,2}$|^[A-Za-z]+[_/+-]?[0-9]{1,4}$|^[A-Za-z]+(?:[_/+-][A-Za-z]+)+[_/+-]?[0-9]{0,4}$")),
            vote(raw.rlike(PREFIXES), raw.rlike(NO_KEYS)),
            vote(cue, near.isin("@", ".", "/", "#") | after.isin("@", "/")),
            vote(turns >= 4, turns <= 2),
            vote(F.lit(False), hit),
        )
        features = (
            F.when(size < 12, "short").when(size < 20, "middle").when(size < 32, "long").otherwise("longest"),
            F.when(raw.rlike("[a-z]") & raw.rlike("[A-Z]"), "both").when(raw.rlike("[a-z]"), "lower").otherwise("upper"),
            F.when(n_digits * 4 < size, "few").when(n_digits * 4 < size * 3, "half").otherwise("most"),
            F.when(start == 0, "start").when(near == " ", "space").when(near.isin("=", ":", '"', "'"), "sign").otherwise("other"),
            F.when(cue, "yes").otherwise("no"),
            F.when(raw.rlike(PREFIXES), "key").when(raw.rlike(NO_KEYS), "name").otherwise("none"),
        )
        return F.struct(start.alias("start"), end.alias("end"), hit.alias("hit"), *(v.cast("int").alias(f"v_{n}") for n, v in zip(LABELERS, votes, strict=True)), *(x.alias(f"f_{n}") for n, x in zip(FEATURES, features, strict=True)))

    def told(parts: Column) -> Column:
        # the part before a match and the one after it; reading them by offset would scan the text each time
        around = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(parts) - 3), F.lit(2)), lambda i: F.struct(F.right(F.get(parts, i), F.lit(20)).alias("before"), F.left(F.get(parts, i + 2), F.lit(1)).alias("after")))
        return F.when(F.size(parts) > 1, F.zip_with(marked_spans(parts), around, judged))

    return let(parts_of(text, CANDIDATE), told)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates) of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.translate(text_or_empty(), MARK, OTHER).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    return rows.select("doc_id", F.transform("base", lambda b: b.dropFields("raw")).alias("base"), F.when(F.col("text").rlike("[A-Za-z0-9_+/-]{8}"), candidates(F.col("text"), F.col("base"))).alias("candidates"))


#: Outcomes of a labeler, and the rates of each among true and among false spans that it starts from and leans to.
OUTCOMES = (1, 0, None)
LEAN = ((0.45, 0.05, 0.5), (0.05, 0.45, 0.5))
LEAN_WEIGHT = 0.1
Rates = list[tuple[tuple[float, ...], tuple[float, ...]]]


def reliabilities(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 50) -> tuple[float, Rates]:
    """(prior, rates of each labeler's outcomes among true and among false spans) by expectation-maximisation over vote-pattern counts."""
    n = len(LABELERS)
    prior, rates = 0.5, [LEAN] * n
    total = sum(c for _, c in patterns)
    lean = LEAN_WEIGHT * total
    for _ in range(rounds if patterns else 0):
        true = [posterior(votes, prior, rates) for votes, _ in patterns]
        yes = sum(p * c for p, (_, c) in zip(true, patterns, strict=True))
        prior = (yes + lean / 2) / (total + lean)
        new = []
        for k in range(n):
            sums = [[sum(w * c for w, (v, c) in zip(weight, patterns, strict=True) if v[k] == o) for o in OUTCOMES] for weight in (true, [1 - p for p in true])]
            new.append(tuple(tuple((x + lean * r) / (sum(side) + lean) for x, r in zip(side, leaning, strict=True)) for side, leaning in zip(sums, LEAN, strict=True)))
        rates = new
    return prior, rates


def posterior(votes: tuple[int | None, ...], prior: float, rates: Rates) -> float:
    odds = math.log(prior / (1 - prior))
    for v, (t, f) in zip(votes, rates, strict=True):
        at = OUTCOMES.index(v)
        odds += math.log(t[at] / f[at])
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def train(found: DataFrame) -> tuple[float, dict[tuple[str, str], float]]:
    """(bias, weight of each feature value) of the span classifier."""
    spans = found.select(F.explode("candidates").alias("c")).select("c.*")
    votes, features = [f"v_{n}" for n in LABELERS], [f"f_{n}" for n in FEATURES]
    # at most 3^5 vote patterns by 4 * 3 * 3 * 4 * 2 * 3 feature values come to the driver
    counts = [(tuple(r[v] for v in votes), tuple(r[f] for f in features), r["n"]) for r in spans.groupBy(*votes, *features).agg(F.count(F.lit(1)).alias("n")).collect()]
    patterns: dict[tuple[int | None, ...], int] = {}
    for v, _, n in counts:
        patterns[v] = patterns.get(v, 0) + n
    prior, rates = reliabilities(sorted(patterns.items(), key=str))
    yes = sum(posterior(v, prior, rates) * n for v, _, n in counts)
    total = sum(n for _, _, n in counts)
    weights: dict[tuple[str, str], float] = {}
    for k, name in enumerate(FEATURES):
        sums: dict[str, list[float]] = {}
        for v, f, n in counts:
            p = posterior(v, prior, rates)
            at = sums.setdefault(f[k], [0.0, 0.0])
            at[0] += p * n
            at[1] += (1 - p) * n
        for value, (t, f) in sums.items():
            weights[name, value] = math.log((t + 1) / (yes + len(sums))) - math.log((f + 1) / (total - yes + len(sums)))
    return math.log((yes + 1) / (total - yes + 1)), weights


def classify(found: DataFrame, bias: float, weights: dict[tuple[str, str], float]) -> DataFrame:
    """(doc_id, base, added): candidates with log odds above 0 that overlap no base span."""
    table_ = F.create_map(*(F.lit(x) for (name, value), w in sorted(weights.items()) for x in (f"{name}={value}", w))) if weights else F.create_map(F.lit("-"), F.lit(0.0))

    def odds(c: Column) -> Column:
        return sum((F.coalesce(table_[F.concat(F.lit(f"{n}="), c[f"f_{n}"])], F.lit(0.0)) for n in FEATURES), F.lit(bias))

    added = F.transform(F.filter(F.coalesce("candidates", F.array()), lambda c: ~c["hit"] & (odds(c) > 0)), lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("no"), c["end"].alias("end"), F.lit("account").alias("kind")))
    return found.select("doc_id", "base", (added if weights else F.filter("base", lambda b: F.lit(False))).alias("added"))


def annotate(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): spans as array<struct<start, no, end, kind>>."""
    found = stored(find(docs), "pii-found")
    return classify(found, *train(found))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = annotate(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("bigint").alias("n_account"), (F.size("base") + F.size("added")).cast("bigint").alias("n_spans"))
