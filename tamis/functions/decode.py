"""Decoding of file bytes: UTF-8 with or without a mark, else Windows-1252, else Latin-1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HIGH = bytes(range(0x80, 0xA0))
_UNDEFINED = b"\x81\x8d\x8f\x90\x9d"
_DEFINED = bytes(b for b in _HIGH if b not in _UNDEFINED)
_FROM, _TO = _DEFINED.decode("latin-1"), _DEFINED.decode("cp1252")


def decode_ladder(content: Column) -> Column:
    """Text of a BINARY column by the first encoding that fits; one leading byte-order mark of UTF-8 goes."""
    latin = F.decode(content, "ISO-8859-1")
    single = F.when(latin.rlike("[" + _UNDEFINED.decode("latin-1") + "]"), latin).otherwise(F.translate(latin, _FROM, _TO))
    utf8 = F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")
    return F.coalesce(utf8, single)


def decode_lossy(content: Column) -> Column:
    """UTF-8 with replacement characters for bytes that are not; a mark stays."""
    return F.make_valid_utf8(content.cast("string"))
