"""The operators as functions of SQL, so that a query of SQL text alone can use them.

A function's body is the text of the very expression that the DataFrame operators use. Spark puts it in place
of the call and plans it as usual: no Python worker runs, and calls are optimised with the query around them. Only
``COSINES`` is an Arrow function, as in the DataFrame operator.
Spark takes no such call within explode, so arrays are selected in one query and exploded in the one around it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tamis.config import DEFAULT, Config
from tamis.functions.text import let, normalize_header
from tamis.operators import blocks, logs
from tamis.operators.classify import char_gram_array, cosines_of, decide, folded, ranked, vocabulary, words_of
from tamis.operators.entities import ENTITIES, anonymize, detect, has_entity, is_brazilian_phone, mask_sensitive_data
from tamis.operators.memo import INFERENCE
from tamis.operators.screening import role

#: The view of the classifier's model: gram, idf, weights by anchor.
VOCABULARY = "symptom_vocabulary"
#: The session's function of folded text that gives its cosines with the anchors; the only one that runs Python.
COSINES = "symptom_cosines"

#: A literal, which stays as it is, or the name of an operator where a function's name stands.
_OPERATORS = re.compile(r"('(?:[^'\\]|\\.)*')|(?<![\w`])(<=>|<=|>=|!=|==|[-+*/%=<>!&|^~]|and|or|in|not)\(", re.DOTALL)


def expression_text(column: Column) -> str:
    """The column as SQL: its own text, with operators called by quoted names."""
    text = str(column).removeprefix("Column<'").removesuffix("'>")
    return _OPERATORS.sub(lambda m: m[1] or f"`{m[2]}`(", text)


def functions(config: Config = DEFAULT) -> dict[str, tuple[str, str, Callable[..., Column]]]:
    """name -> (parameters, returned type, expression of the parameters)."""
    return {
        "detect_entities": ("text string", ENTITIES, detect),
        "mask_sensitive_data": ("text string", "string", mask_sensitive_data),
        "anonymize": ("text string", f"struct<masked:string,entities:{ENTITIES}>", anonymize),
        "has_entity": (f"entities {ENTITIES}, kind string, least string", "boolean", has_entity),
        "is_brazilian_phone": ("text string", "boolean", is_brazilian_phone),
        "normalize_header": ("text string", "string", normalize_header),
        "ticket_text": ("raw_text string", "string", lambda raw: let(blocks.parse(raw), lambda parsed: blocks.analysis_text(raw, parsed))),
        "log_signature": ("line string", "struct<symptom:string,label:string>", logs.match),
        "attachment_role": ("name string", "string", role),
        "folded_text": ("text string", "string", folded),
        "symptom_words": ("text string", "array<string>", words_of),
        "word_grams": ("word string", "array<string>", lambda word: char_gram_array(word, config)),
        "symptom_of": ("text string, cosines array<double>", INFERENCE, lambda text, cosines: decide(text, ranked(cosines), config)),
    }


def register(spark: SparkSession, database: str | None = None, config: Config = DEFAULT) -> list[str]:
    """Make the functions, and the view of the classifier's model; their names are returned.

    They belong to the session, or, with a database, to its catalog, where other sessions find them. Made again they
    are replaced. Nulls are as in the DataFrame operators. The view and ``COSINES`` are always the session's.
    """
    made = []
    for name, (parameters, returned, body) in functions(config).items():
        columns = [F.col(p.split()[0]) for p in parameters.split(", ")]
        where, kind = (name, "temporary function") if database is None else (f"`{database}`.{name}", "function")
        spark.sql(f"create or replace {kind} {where}({parameters}) returns {returned} return {expression_text(body(*columns))}")
        made.append(where)
    vocabulary(spark, config).createOrReplaceTempView(VOCABULARY)
    spark.udf.register(COSINES, cosines_of(config.nlp_ngram_min, config.nlp_ngram_max))
    return made
