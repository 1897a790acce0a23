"""Replacement of spans: route each entity type to an operator, make its value, splice. No row moves.

Native operators (mask, redact, hash, cap, fake) are expressions. The others (dates, names, places, format-preserving
encryption) are one Arrow function that gets a note's texts for them, not the note, and keeps the values it has made
lately, for names, dates and places repeat. All values are keyed and depend on what an operator reads alone, so the
same text gets the same value wherever it stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.keyed import Keys, accession_hash, jitter_or_default
from cloakwork.operators import ages, dates, fake, fpe, locations, names
from cloakwork.operators.spans import resolve_results
from cloakwork.schema import ITEM, ITEMS, no_spans

# The operator of each entity type; any other type is redacted.
ROUTES = {
    "DEFAULT": "redact",
    "OTHER": "redact",
    "BASE64_IMAGE": "redact",
    "GENETIC_SEQUENCE": "fake",
    "AGE": "age_grouping",
    "EMAIL_ADDRESS": "fake",
    "WEB": "fake",
    "URL": "fake",
    "ORGANIZATION": "fake",
    "PHONE": "hips_alphanumeric",
    "PHONE_NUMBER": "hips_alphanumeric",
    "US_SSN": "hips_alphanumeric",
    "MEDICAL_LICENSE": "hips_alphanumeric",
    "MRN": "hips_alphanumeric",
    "HAR": "hips_alphanumeric",
    "ID": "hips_alphanumeric",
    "CSN_ID": "hips_alphanumeric",
    "VENDOR": "hips_location",
    "ZIP_CODE": "hips_location",
    "LOCATION": "hips_location",
    "HOSPITAL": "hips_location",
    "PERSON": "hips_names",
    "DOCTOR": "hips_names",
    "PATIENT": "hips_names",
    "HCW": "hips_names",
    "DATE": "date_jitter",
    "DATE_TIME": "date_jitter",
    "ACC_NUM": "accession_number_hash",
}
#: Types whose neighbours are joined before replacement.
MERGE_TYPES = ("PERSON", "PATIENT", "DOCTOR", "HCW", "LOCATION", "HOSPITAL", "ORGANIZATION", "VENDOR", "DATE", "DATE_TIME", "AGE")
OPERATORS = ("redact", "masking", "fake", "age_grouping", "hips_alphanumeric", "hips_location", "hips_names", "date_jitter", "accession_number_hash", "faker_anonymizer", "keep")


@dataclass(frozen=True)
class Settings:
    """How spans are replaced. year: of dates without one; study and salt: of accession hashes; names, cities, streets
    and facilities: what names and places become (None: the built-in lists)."""

    keys: Keys = field(repr=False)
    year: int
    routes: Mapping[str, str] = field(default_factory=lambda: dict(ROUTES))
    age_limit: int = ages.LIMIT
    salt: str | None = field(default=None, repr=False)
    study: str | None = None
    jitter_required: bool = False
    stopwords: tuple[str, ...] = ()
    merge_types: tuple[str, ...] = MERGE_TYPES
    names: tuple[str, ...] | None = None
    cities: tuple[str, ...] | None = None
    streets: tuple[str, ...] | None = None
    facilities: tuple[str, ...] | None = None

    def __post_init__(self):
        unknown = set(self.routes.values()) - set(OPERATORS)
        if unknown:
            raise ValueError(f"unknown operators {sorted(unknown)}")


def route(entity: Column, routes: Mapping[str, str] = ROUTES) -> Column:
    out = None
    by: dict[str, list[str]] = {}
    for e, o in routes.items():
        by.setdefault(o, []).append(e)
    for o, entities in by.items():
        test = entity.isin(entities)
        out = F.when(test, o) if out is None else out.when(test, o)
    return out.otherwise(routes.get("DEFAULT", "redact"))


def mask(entity: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(entity, F.lit("UNKNOWN")), F.lit("]"))


def splice(text: Column, items: Column) -> Column:
    """struct(text, items) with items' spans replaced; items (start, end, entity_type, text, operator) are sorted and
    disjoint, in coordinates of the input; those returned are in coordinates of the output."""

    def move(a: Column, x: Column) -> Column:
        """by: how far the output is ahead of the input; piece: the text before the item."""
        start = x["start"] + a["by"]
        item = F.struct(start.alias("start"), (start + F.length(x["text"])).alias("end"), x["entity_type"].alias("entity_type"), x["text"].alias("text"), x["operator"].alias("operator"))
        piece = F.struct(F.substring(text, a["at"] + 1, x["start"] - a["at"]).alias("piece"), item.alias("item"))
        by = a["by"] + F.length(x["text"]) - (x["end"] - x["start"])
        return F.struct(by.alias("by"), x["end"].alias("at"), F.array_append(a["done"], piece).alias("done"))

    def whole(a: Column) -> Column:
        parts = F.flatten(F.transform(a["done"], lambda d: F.array(d["piece"], d["item"]["text"])))
        rest = F.substring(text, a["at"] + 1, F.length(text))
        return F.struct(F.concat(F.array_join(parts, ""), rest).alias("text"), F.transform(a["done"], lambda d: d["item"]).alias("items"))

    start = F.struct(F.lit(0).alias("by"), F.lit(0).alias("at"), F.array().cast(f"array<struct<piece: string, item: {ITEM}>>").alias("done"))
    return F.aggregate(items, start, move, whole)


def mask_text(text: Column, spans: Column) -> Column:
    """text with each resolved span replaced by its type in brackets."""
    items = F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["entity_type"], mask(s["entity_type"]).alias("text"), F.lit("masking").alias("operator")).cast("struct<start: int, end: int, entity_type: string, text: string, operator: string>"))
    return F.when(F.size(spans) == 0, text).otherwise(splice(text, items)["text"])


#: Values that a task keeps.
MEMO = 100_000
SLOW = ("date_jitter", "hips_names", "hips_location")


def native_value(operator: Column, entity: Column, text: Column, patient: Column, s: Settings) -> Column:
    return (
        F.when(operator == "redact", F.lit(""))
        .when(operator == "keep", text)
        .when(operator == "masking", mask(entity))
        .when(operator == "hips_alphanumeric", fpe.encrypt(text, s.keys))
        .when(operator == "age_grouping", ages.cap_age(text, s.age_limit))
        .when(operator == "accession_number_hash", accession_hash(text, F.lit(s.salt), F.lit(s.study), patient))
        .when(operator.isin("fake", "faker_anonymizer"), fake.fake(entity, text, s.keys))
    )


def makers(s: Settings) -> dict[str, Callable[[list[str], list[int]], list[str | None]]]:
    """The slow operators, by name, as functions of texts and jitters."""
    namer = names.Namer(s.keys, s.names or names.default_names(), s.stopwords)
    placer = locations.Placer(s.keys, s.facilities or locations.FACILITIES, s.streets or locations.STREETS, s.cities or locations.CITIES, s.stopwords)
    return {
        "date_jitter": lambda texts, days: [dates.shift_date(t, d, s.year) for t, d in zip(texts, days)],
        "hips_names": lambda texts, days: [namer.replace(t) for t in texts],
        "hips_location": lambda texts, days: [placer.replace(t) for t in texts],
    }


def slow_values(asked: Column, jitter: Column, settings: Settings) -> Column:
    """array<string> for asked, array<struct<operator, text>>: a value for each, null where the text is."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made, known = makers(settings), {}
        for rows, days in batches:
            # what an operator does not read must not split its values
            keys = [[(x["operator"], x["text"], int(d) if x["operator"] == "date_jitter" else 0) if x["text"] is not None else None for x in row] for row, d in zip(rows, days)]
            if len(known) > MEMO:
                known.clear()
            new = {k for row in keys for k in row if k is not None and k not in known}
            for operator, make in made.items():
                own = [k for k in new if k[0] == operator]
                known.update(zip(own, make([k[1] for k in own], [k[2] for k in own])))
            yield pd.Series([[None if k is None else known[k] for k in row] for row in keys])

    return run(asked, jitter)


def anonymize(notes: DataFrame, settings: Settings) -> DataFrame:
    """notes(note_text, spans[, patient_uid, jitter]) with anonymized_note_text, items, entity_count, processing_status
    and error_message.

    Spans are resolved first. A null text stays null; a note is never dropped. Each row is done for itself, so texts
    that several patients share, with or without a row_id, get each patient's values.
    """
    patient = F.col("patient_uid") if "patient_uid" in notes.columns else F.lit(None).cast("string")
    given = F.col("jitter") if "jitter" in notes.columns else F.lit(None).cast("int")
    text = F.col("note_text")
    routed = F.transform(
        resolve_results(F.coalesce(F.col("spans"), no_spans()), "longest_wins", settings.merge_types, text),
        lambda s: F.struct(s["start"], s["end"], s["entity_type"], route(s["entity_type"], settings.routes).alias("operator"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("original")),
    )
    rows = notes.withColumns({"__items": F.array_sort(routed), "__jitter": jitter_or_default(given, patient, settings.keys, settings.jitter_required), "__patient": patient})
    slow = [n for n in SLOW if n in settings.routes.values()]
    none = F.lit(None).cast("string")
    asked = F.transform("__items", lambda x: F.struct(x["operator"], F.when(x["operator"].isin(slow), x["original"]).otherwise(none).alias("text")))
    made = slow_values(asked, F.col("__jitter"), settings) if slow else F.transform("__items", lambda x: none)
    rows = rows.withColumn("__made", made)

    def item(x: Column, value: Column) -> Column:
        new = F.coalesce(value, native_value(x["operator"], x["entity_type"], x["original"], F.col("__patient"), settings), F.lit(""))
        return F.struct(x["start"], x["end"], x["entity_type"], new.alias("text"), x["operator"])

    items = F.zip_with("__items", "__made", item).cast(ITEMS)
    untouched = F.struct(text.alias("text"), F.array().cast(ITEMS).alias("items"))
    done = F.when(F.coalesce(F.size("__items"), F.lit(0)) == 0, untouched).otherwise(splice(text, items))
    return rows.withColumn("__done", done).select(
        *notes.columns,
        F.col("__done.text").alias("anonymized_note_text"),
        F.col("__done.items").alias("items"),
        F.size("__done.items").alias("entity_count"),
        F.when(text.isNull(), "skipped").otherwise("success").alias("processing_status"),
        F.when(text.isNull(), "note_text is null").alias("error_message"),
    )
