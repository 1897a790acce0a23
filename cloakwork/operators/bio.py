"""Token predictions to entities: labels agree within a word, then tokens of one type form spans.

Long forms: one row a token (key, start, end, entity, score, word), gaps-and-islands by windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.schema import TOKENS

MAX_GAP, SURE = 2, 0.8
#: Marks of tokens that begin a word.
WORD_STARTS = ("Ġ", "▁")


def bare(entity: Column) -> Column:
    return F.regexp_replace(entity, "^[BI]-", "")


def _order(key: str):
    return Window.partitionBy(key).orderBy("start", "end", "entity")


def normalise(tokens: DataFrame, key: str, text: str | None = None) -> DataFrame:
    """Give all tokens of a word one type: that of the last sure token, else that of the best mean score.

    A word's tokens follow each other with a gap of at most 2 without white space (the column text, if there is one,
    tells) and no mark of a new word. B- and I- stay.
    """
    w = _order(key)
    gap = F.col("start") - F.lag("end").over(w)
    blank = F.substring(F.col(text), F.lag("end").over(w) + 1, F.greatest(gap, F.lit(0))).rlike(r"\s") if text else F.lit(False)
    marked = reduce(lambda a, b: a | b, (F.startswith(F.col("word"), F.lit(m)) for m in WORD_STARTS))
    new = F.when((gap <= MAX_GAP) & ~blank & ~marked, 0).otherwise(1)
    grouped = tokens.withColumn("__new", new).withColumn("__n", F.row_number().over(w)).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__type", bare(F.col("entity")))
    g = Window.partitionBy(key, "__g")
    sure = F.max(F.when(F.col("score") >= SURE, F.struct(F.col("__n").alias("n"), F.col("__type").alias("t")))).over(g)
    by_type = Window.partitionBy(key, "__g", "__type")
    rated = grouped.withColumn("__mean", F.round(F.avg("score").over(by_type), 9)).withColumn("__first", F.min("__n").over(by_type))
    best = F.max(F.struct(F.col("__mean").alias("m"), (-F.col("__first")).alias("f"), F.col("__type").alias("t"))).over(g)
    rated = rated.withColumn("__sure", sure).withColumn("__best", best)
    label = F.coalesce(F.col("__sure.t"), F.col("__best.t"))
    prefix = F.regexp_extract("entity", "^([BI]-)", 1)
    return rated.withColumn("entity", F.concat(prefix, label)).select(*tokens.columns)


def aggregate(tokens: DataFrame, key: str) -> DataFrame:
    """Spans (key, entity_group, start, end, score): tokens of one type with a gap of at most 2 from the last.
    B- and I- are treated alike; the score is the mean."""
    w = _order(key)
    typed = tokens.withColumn("__type", bare(F.col("entity")))
    joins = (F.lag("__type").over(w) == F.col("__type")) & (F.col("start") - F.lag("end").over(w) <= MAX_GAP)
    marked = typed.withColumn("__new", F.when(joins, 0).otherwise(1)).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "__g").agg(F.min("__type").alias("entity_group"), F.min("start").alias("start"), F.max("end").alias("end"), F.round(F.avg("score"), 9).alias("score")).drop("__g")


def dedupe_tokens(tokens: Column) -> Column:
    return F.array_distinct(tokens)


def parse_tokens(tokens_json: Column) -> Column:
    """struct(tokens, chunk_status): text that is no JSON array of tokens gives none, and "failed"."""
    got = F.from_json(tokens_json, TOKENS)
    ok = got.isNotNull() & tokens_json.rlike(r"(?s)^\s*\[.*\]\s*$")
    return F.struct(F.when(ok, got).otherwise(F.array().cast(TOKENS)).alias("tokens"), F.when(ok, "success").otherwise("failed").alias("chunk_status"))


Model = Callable[[list[str]], list[list[dict]]]


def tag(text: Column, load: Callable[[], Model], ignored: tuple[str, ...] = ("O",)) -> Column:
    """Raw tokens by a model that load() makes once a worker; labels in ignored are left out."""

    @F.pandas_udf(TOKENS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            yield pd.Series([[t for t in found if t["entity"] not in ignored] for found in model([t or "" for t in s])])

    return run(text)


def map_labels(spans: Column, labels: dict[str, str], id_label: str | None = None, multiplier: float = 1.0) -> Column:
    """Entity types by a model's label map; the score of id_label is multiplied."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else None

    def one(s: Column) -> Column:
        t = F.coalesce(table[s["entity_type"]], s["entity_type"]) if table is not None else s["entity_type"]
        score = F.when(s["entity_type"] == id_label, s["score"] * multiplier).otherwise(s["score"]) if id_label else s["score"]
        return F.struct(t.alias("entity_type"), s["start"], s["end"], score.alias("score"), s["recognizer"], s["pattern"])

    return F.transform(spans, one)
