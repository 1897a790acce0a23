"""Spans from a language model's reply: a JSON object of entity types, each with texts and confidences.

The model is any callable from prompt to reply; it runs in an Arrow function with retries. Parsing and locating are
plain expressions and need no model.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.text import strip_fences
from cloakwork.operators.chunk import WINDOW, WINDOW_OVERLAP, window_starts
from cloakwork.operators.spans import by_position, longest_wins, shift
from cloakwork.schema import SPANS, no_spans

REPLY = "map<string, array<struct<text: string, confidence: double>>>"


def located(text: Column, reply: Column) -> Column:
    """Spans of every exact occurrence of each text that a reply names; of one (text, type) the first confidence
    holds; longest wins."""
    parsed = F.map_entries(F.from_json(strip_fences(reply), REPLY))
    named = F.flatten(F.transform(parsed, lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("type"), v["text"].alias("text"), F.coalesce(v["confidence"], F.lit(0.9)).alias("confidence")))))
    named = F.filter(named, lambda n: n["text"].isNotNull() & (F.length(n["text"]) > 0))
    kind = "array<struct<type: string, text: string, confidence: double>>"
    once = F.aggregate(named, F.array().cast(kind), lambda a, n: F.when(F.exists(a, lambda k: (k["type"] == n["type"]) & (k["text"] == n["text"])), a).otherwise(F.array_append(a, n)))

    def occurrences(n: Column) -> Column:
        parts = F.split(text, F.concat(F.lit(r"\Q"), n["text"], F.lit(r"\E")), -1)
        ends = F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<int>"), lambda a, p: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(p) + F.length(n["text"])))
        return F.transform(ends, lambda e: F.struct(n["type"].alias("entity_type"), (e - F.length(n["text"])).alias("start"), e.alias("end"), n["confidence"].alias("score"), F.lit("LLM").alias("recognizer"), F.lit("exact").alias("pattern")))

    spans = F.flatten(F.transform(once, occurrences)).cast(SPANS)
    return F.coalesce(longest_wins(by_position(spans)), no_spans())


def ask(prompts: Column, load: Callable[[], Callable[[str], str]], attempts: int = 3, wait: float = 1.0) -> Column:
    """Replies, array<string>, to an array of prompts, by a model that load() makes once a task; null after `attempts`
    failures, with doubling waits."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def one(p: str) -> str | None:
            for k in range(attempts):
                try:
                    return model(p)
                except Exception:  # whatever a client raises is retried, then given up
                    if k + 1 < attempts:
                        time.sleep(wait * 2**k)
            return None

        for s in batches:
            yield s.map(lambda prompts: [one(p) for p in prompts])

    return run(prompts)


def recognize(notes: DataFrame, prompt: str, load: Callable[[], Callable[[str], str]], attempts: int = 3, wait: float = 1.0, size: int = WINDOW, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """notes(note_text, ...) with spans, processing_status and error_message.

    A text longer than size is asked about window by window, and the spans are moved to their places and resolved; if a
    window has no reply the note has failed. A null text is skipped.
    """
    text = F.col("note_text")
    windows = F.transform(F.coalesce(window_starts(F.length(text), size, overlap), F.array().cast("array<int>")), lambda a: F.struct(a.alias("at"), F.substring(text, a + 1, F.lit(size)).alias("window")))
    rows = notes.withColumn("__windows", windows)
    rows = rows.withColumn("__replies", ask(F.transform("__windows", lambda w: F.concat(F.lit(prompt), F.lit("\n\n"), w["window"])), load, attempts, wait))
    found = F.flatten(F.zip_with("__windows", "__replies", lambda w, r: shift(located(w["window"], r), w["at"])))
    ok = ~F.exists("__replies", lambda r: r.isNull())
    spans = F.when(ok, longest_wins(by_position(F.array_distinct(found)))).otherwise(no_spans())
    status = F.when(text.isNull(), "skipped").when(ok, "success").otherwise("failed")
    return rows.select(*notes.columns, spans.alias("spans"), status.alias("processing_status"), F.when(text.isNull(), "note_text is null").when(~ok, "no reply").alias("error_message"))
