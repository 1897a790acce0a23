"""Scalar functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: recognizers by the start of their names.
CATEGORIES = {
    "TransformersRecognizer": "transformer",
    "KnownValues": "known_values",
    "LLM": "llm",
    "Cached": "transformer",
    "Institution": "dictionary",
    "Address": "regex",
    "Email": "regex",
    "Phone": "regex",
    "SSN": "regex",
    "URL": "regex",
    "MRN": "regex",
    "HAR": "regex",
    "Accession": "regex",
}


def estimate_tokens(text: Column) -> Column:
    """Characters / 4, rounded half to even, 1 at least; 0 for an empty text."""
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(n / 4, 0).cast("int")))


def name_words(value: Column) -> Column:
    """Distinct words of a person's name; commas separate, too."""
    return F.array_distinct(F.filter(F.split(F.replace(value, F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != ""))


def strip_fences(reply: Column) -> Column:
    """A model's reply without the first and last line of a code fence."""
    t = F.trim(reply)
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?```\s*$", ""))


def category(recognizer: Column, prefixes: dict[str, str] | None = None, other: str = "other") -> Column:
    out = None
    for p, c in (prefixes or CATEGORIES).items():
        test = F.startswith(recognizer, F.lit(p))
        out = F.when(test, c) if out is None else out.when(test, c)
    return out.otherwise(other)


def is_spurious(value: Column, stopwords: list[str] | None = None) -> Column:
    """Empty, one character, a stopword, or without any letter or digit."""
    t = F.trim(value)
    bad = value.isNull() | (F.length(t) <= 1) | ~t.rlike(r"[\p{L}\p{N}]")
    return bad | F.lower(t).isin(stopwords) if stopwords else bad


def store_path(uri: Column) -> Column:
    """bucket and key of an object's URI."""
    return F.struct(F.regexp_extract(uri, r"^[a-z0-9]+://([^/]+)", 1).alias("bucket"), F.regexp_extract(uri, r"^[a-z0-9]+://[^/]+/(.*)$", 1).alias("key"))
