"""Types and identities of notes and spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A half-open range of code points with what was found there.
SPAN = "struct<entity_type: string, start: int, end: int, score: double, recognizer: string, pattern: string>"
SPANS = f"array<{SPAN}>"
#: A replacement, in coordinates of the output text.
ITEM = "struct<start: int, end: int, entity_type: string, text: string, operator: string>"
ITEMS = f"array<{ITEM}>"
#: A piece of a document, without the document's text.
CHUNK = "text_hash string, patient_id string, chunk_id int, chunk_text string, char_offset_start int, chunk_uid string"
#: A raw token prediction of a tagger.
TOKENS = "array<struct<entity: string, score: double, start: int, end: int, word: string, index: int>>"
IDENTIFIERS = "map<string, array<string>>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def text_hash(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 text."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def row_id(hash_: Column, patient_uid: Column) -> Column:
    """One text may belong to several patients; a missing patient counts as "None"."""
    return F.sha2(F.concat_ws(":", hash_, F.coalesce(patient_uid, F.lit("None"))), 256)


def require_columns(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> list[str]:
    """The columns to read, in df's spelling: all required and those optional ones that exist."""
    have = {c.lower(): c for c in df.columns}
    missing = [c for c in required if c.lower() not in have]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return [have[c.lower()] for c in (*required, *optional) if c.lower() in have]
