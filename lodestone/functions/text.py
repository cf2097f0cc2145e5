"""Tokens of documents and of searches."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: words that are not indexed
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "is", "it", "its", "this", "that", "with", "by", "from")
MIN_LENGTH, MAX_TOKENS = 2, 100
# fixed values: Arabic marks that are dropped, and what separates tokens
DIACRITICS, TATWEEL = "[ً-ٰٟ]", "ـ"
SEPARATORS = "[^؀-ۿݐ-ݿ0-9A-Za-z_]+"


def normalised(text: Column) -> Column:
    # one pass for both kinds of marks; texts without them, nearly all, are only scanned
    marks = f"{DIACRITICS}|{TATWEEL}"
    return F.trim(F.lower(F.when(text.rlike(marks), F.regexp_replace(text, marks, "")).otherwise(text)))


def tokens(text: Column, stop_words: Iterable[str] = STOP_WORDS, min_length: int = MIN_LENGTH, most: int = MAX_TOKENS) -> Column:
    """Distinct tokens in order of appearance, at most `most`; null text has none."""
    words = F.split(normalised(text), SEPARATORS)
    stop = list(stop_words)
    kept = F.filter(words, lambda w: (F.char_length(w) >= min_length) & (~w.isin(stop) if stop else F.lit(True)))
    return F.coalesce(F.slice(F.array_distinct(kept), 1, most), F.array().cast("array<string>"))


def normalise_query(query: str) -> str:
    return re.sub(TATWEEL, "", re.sub(DIACRITICS, "", query)).lower().strip()


def query_tokens(query: str, min_length: int = MIN_LENGTH) -> list[str]:
    """Tokens of a search. Stop words stay, and so does everything beyond the hundredth."""
    return list(dict.fromkeys(w for w in re.split(SEPARATORS, normalise_query(query)) if len(w) >= min_length))


def searchable_text(fields: Iterable[tuple[str, T.DataType]], allowed: Iterable[str] = (), base: Column | None = None) -> Column:
    """Texts, numbers and truth values of a record's fields, joined by blanks; an allow-list holds at every level of nesting."""
    allowed = set(allowed)
    parts = []
    for name, kind in fields:
        if allowed and name not in allowed:
            continue
        column = F.col(name) if base is None else base[name]
        if isinstance(kind, T.StructType):
            parts.append(searchable_text([(f.name, f.dataType) for f in kind.fields], allowed, column))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.NumericType, T.BooleanType)):
            parts.append(F.concat_ws(" ", column.cast("array<string>")))
        elif isinstance(kind, (T.StringType, T.NumericType, T.BooleanType)):
            parts.append(column.cast("string"))
    return F.concat_ws(" ", *(F.when(p != "", p) for p in parts)) if parts else F.lit("")
