"""Known values: a patient's own identifiers found anywhere in a note. (Patterns of a dictionary: dictionary.py.)

known_values() builds, in each row, an automaton of that row's identifiers, in an Arrow function; many values and a
long text cost one pass. find_values() is the native form for few values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.operators.dictionary import Dictionary, dictionary  # noqa: F401  also known values
from cloakwork.operators.spans import merge_continuous
from cloakwork.schema import SPANS
from cloakwork.sources.shared import hot_join

# Entity types of identifier kinds, the score, and gaps closed between hits.
KINDS = {
    "person": "PATIENT",
    "phone_number": "PHONE",
    "location": "LOCATION",
    "email_address": "EMAIL_ADDRESS",
    "mrn": "MRN",
    "har": "HAR",
    "acc_num": "ACC_NUM",
    "csn_id": "CSN_ID",
    "us_ssn": "US_SSN",
    "url": "URL",
    "medical_license": "MEDICAL_LICENSE",
    "ip_address": "IP_ADDRESS",
}
SCORE = 0.95
GAPS = {"PATIENT": 1, "LOCATION": 3}


def fold(text: str) -> str:
    """Lower case, one character for each, so that offsets hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def usable(kind: str, values: Sequence[str | None], stopwords: frozenset[str]) -> list[str]:
    """Words of names, other values whole; without spurious ones."""
    out: list[str] = []
    for v in values:
        out += re.split(r"[\s,]+", v or "") if kind == "person" else [(v or "").strip()]
    return [v for v in dict.fromkeys(out) if len(v) > 1 and any(c.isalnum() for c in v) and v.lower() not in stopwords]


def automaton(identifiers: Mapping[str, Sequence[str] | None], stopwords: frozenset[str] = frozenset()):
    """What finds all values of the identifiers in one pass over a text; None if there are none."""
    import ahocorasick

    words: dict[str, set[str]] = {}
    for kind, values in identifiers.items():
        if kind in KINDS:
            for v in usable(kind, values if values is not None else (), stopwords):
                words.setdefault(fold(v), set()).add(KINDS[kind])
    if not words:
        return None
    found = ahocorasick.Automaton()
    for w, types in words.items():
        found.add_word(w, (w, sorted(types)))
    found.make_automaton()
    return found


def occurrences(found, text: str | None, overlapping: bool = True) -> list[tuple[str, int, int]]:
    """(entity type, start, end) of every occurrence; without overlapping, those of one value from the left that don't."""
    if found is None or not text:
        return []
    out: list[tuple[str, int, int]] = []
    ends: dict[str, int] = {}
    for e, (w, types) in found.iter(fold(text)):
        start = e + 1 - len(w)
        if overlapping or start >= ends.get(w, 0):
            ends[w] = e + 1
            out += ((t, start, e + 1) for t in types)
    return sorted(out)


def hits(text: str, identifiers: dict[str, Sequence[str]], stopwords: frozenset[str] = frozenset()) -> list[tuple[str, int, int]]:
    return occurrences(automaton(identifiers, stopwords), text)


def _of_type(spans: Column, entity: str) -> Column:
    return F.filter(spans, lambda s: s["entity_type"] == entity)


def known_values(text: Column, identifiers: Column, stopwords: Sequence[str] = (), merge: bool = True) -> Column:
    """Spans of a row's identifiers map<kind, values>; hits of names and places that stand together are joined."""
    stop = frozenset(s.lower() for s in stopwords)

    @F.pandas_udf("array<struct<entity_type: string, start: int, end: int>>")
    def run(t: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([[{"entity_type": e, "start": a, "end": b} for e, a, b in hits(x or "", dict(m) if m is not None else {}, stop)] for x, m in zip(t, ids)])

    return _spans(run(text, identifiers), text, merge)


def _spans(found: Column, text: Column, merge: bool) -> Column:
    """Spans of struct(entity_type, start, end); hits of names and places that stand together are joined."""
    spans = F.transform(found, lambda s: F.struct(s["entity_type"], s["start"], s["end"], F.lit(SCORE).alias("score"), F.lit("KnownValues").alias("recognizer"), F.lit("known").alias("pattern"))).cast(SPANS)
    if not merge:
        return spans
    parts = [merge_continuous(_of_type(spans, t), text, gap) for t, gap in GAPS.items()]
    return F.concat(F.filter(spans, lambda s: ~s["entity_type"].isin(list(GAPS))), *parts)


#: Notes of a patient that one automaton serves, about.
NOTES = 2000
_HIT = "array<struct<entity_type: string, start: int, end: int>>"


def _by_patient(stopwords: frozenset[str], overlapping: bool = True):
    """Rows (patient, salt, place, identifiers, row, text), sorted: identifiers (place 0), then notes (place 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, given, found, built = None, {}, None, True
        for b in batches:
            spans, notes = [], []
            for i, (patient, salt, place, ids, text) in enumerate(zip(*(b.column(k).to_pylist() for k in ("patient", "salt", "place", "identifiers", "text")))):
                if (patient, salt) != group:
                    group, given, found, built = (patient, salt), {}, None, True
                if place == 0:
                    for e in ids or ():
                        given.setdefault(e["key"], []).extend(e["value"] or ())
                    built = False
                    continue
                if not built:
                    found, built = automaton(given, stopwords), True
                notes.append(i)
                spans.append([{"entity_type": t, "start": s, "end": e} for t, s, e in occurrences(found, text, overlapping)])
            kind = pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(notes, pa.int64())), pa.array(spans, kind)], ["row", "found"])

    return run


def known_by_patient(notes: DataFrame, patients: DataFrame, patient: str = "patient_uid", stopwords: Sequence[str] = (), merge: bool = True, overlapping: bool = True) -> DataFrame:
    """notes(patient, note_text, ...) with spans of their patient's identifiers: patients(patient, identifiers), a map of
    kinds to values.

    Notes are dealt out by patient, those of a patient with very many in parts of about NOTES; each part meets the
    patient's identifiers once, and one automaton serves all its notes. For masking, occurrences of a value that overlap
    ("anana" in "ananana") are needed, all of them; for counting, overlapping=False leaves those from the left.

    Defined cases: a note without patient, or whose patient has no identifiers, has no spans, nor has a null text; a
    patient of several rows has all their identifiers; no note is dropped.
    """
    stop = frozenset(s.lower() for s in stopwords)
    row = F.struct(*(F.col(c) for c in notes.columns))
    whole = notes.select(F.col(patient).alias("patient"), F.col("note_text").cast("string").alias("text"), row.alias("row"))
    named = whole.where(F.col("patient").isNotNull())
    parts = named.groupBy("patient").agg(F.ceil(F.count("*") / NOTES).cast("int").alias("parts"))
    dealt = hot_join(named, parts, "patient").withColumn("salt", F.pmod(F.xxhash64("text", F.to_json("row")), F.col("parts")).cast("int"))
    heads = patients.select(F.col(patient).alias("patient"), F.map_entries("identifiers").alias("identifiers")).join(parts, "patient")
    heads = heads.select("patient", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("place"), "identifiers")
    none = F.lit(None).cast(heads.schema["identifiers"].dataType)
    rows = dealt.select("patient", "salt", F.lit(1).alias("place"), none.alias("identifiers"), "row", "text").unionByName(heads, allowMissingColumns=True)
    out = T.StructType([T.StructField("row", whole.schema["row"].dataType), T.StructField("found", T._parse_datatype_string(_HIT))])
    sorted_ = rows.repartition(F.xxhash64("patient", "salt")).sortWithinPartitions("patient", "salt", "place")
    found = sorted_.mapInArrow(_by_patient(stop, overlapping), out)
    rest = whole.where(F.col("patient").isNull()).select("row", F.array().cast(_HIT).alias("found"))
    found = found.unionByName(rest)
    return found.select("row.*", _spans(F.col("found"), F.coalesce(F.col("row.note_text").cast("string"), F.lit("")), merge).alias("spans"))


def find_values(text: Column, values: Column) -> Column:
    """Native: (value, start, end) of the occurrences, in any case, of each of an array of values; of one value they
    don't overlap."""

    def of(v: Column) -> Column:
        parts = F.split(F.lower(text), F.concat(F.lit(r"\Q"), F.lower(v), F.lit(r"\E")), -1)
        ends = F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<int>"), lambda a, p: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(p) + F.length(v)))
        return F.transform(ends, lambda e: F.struct(v.alias("value"), (e - F.length(v)).alias("start"), e.alias("end")))

    return F.flatten(F.transform(values, of))
