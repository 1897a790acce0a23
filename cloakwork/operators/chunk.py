"""Long documents: plan chunks, explode them, and put predictions of chunks together again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.operators.spans import longest_wins, by_position, suppress
from cloakwork.schema import SPANS, no_spans, text_hash

#: Characters a token has, by rule of thumb.
TOKEN = 4
WINDOW, WINDOW_OVERLAP = 100_000, 2_000


def plan_chunks(n: Column, chunk: int, overlap: int) -> Column:
    """array<struct<start, end>> for a text of n characters; chunk and overlap in tokens.

    One chunk if the text has fewer tokens than chunk; an overlap that leaves no step is halved.
    """
    if chunk <= overlap:
        overlap = chunk // 2
    last = n - TOKEN * overlap - 1
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(TOKEN * (chunk - overlap)))
    many = F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), F.least(s + TOKEN * chunk, n).cast("int").alias("end")))
    one = F.array(F.struct(F.lit(0).alias("start"), n.cast("int").alias("end")))
    return F.when(F.floor(n / TOKEN) < chunk, one).when(last < 0, F.slice(one, 1, 0)).otherwise(many)


def chunk_documents(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunk rows of docs(note_text[, text_hash, patient_id]); the whole text is not carried along."""
    hash_ = F.coalesce(F.col("text_hash"), text_hash(F.col("note_text"))) if "text_hash" in docs.columns else text_hash(F.col("note_text"))
    patient = F.coalesce(F.col("patient_id").cast("string"), F.lit("")) if "patient_id" in docs.columns else F.lit("")
    rows = docs.select(hash_.alias("text_hash"), patient.alias("patient_id"), F.col("note_text").alias("__t"), F.posexplode(plan_chunks(F.length("note_text"), chunk, overlap)).alias("chunk_id", "c"))
    return rows.select("text_hash", "patient_id", "chunk_id", F.substring("__t", F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("chunk_text"), F.col("c.start").alias("char_offset_start"), F.concat_ws("_", "text_hash", "chunk_id").alias("chunk_uid"))


def joined(chunks: Column) -> Column:
    """The text of sorted chunks, an array of struct(char_offset_start, chunk_text, ...): each adds what the ones before
    it lack."""

    def add(a: Column, x: Column) -> Column:
        new = F.substring(x["chunk_text"], a["n"] - x["char_offset_start"] + 1, F.length(x["chunk_text"]))
        return F.struct((a["n"] + F.length(new)).alias("n"), F.array_append(a["parts"], new).alias("parts"))

    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(chunks, start, add, lambda a: F.array_join(a["parts"], ""))


def whole_texts(chunks: DataFrame) -> DataFrame:
    """text_hash and note_text of the texts that chunks(text_hash, char_offset_start, chunk_text) were cut from."""
    grouped = chunks.groupBy("text_hash").agg(F.sort_array(F.collect_list(F.struct("char_offset_start", "chunk_text"))).alias("c"))
    return grouped.select("text_hash", joined(F.col("c")).alias("note_text"))


def first_by(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Of each key the row with the least value of order; of equal ones the least row. Combined before the exchange."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(order, *rest)).alias("__row")).select(*key, "__row.*").select(*df.columns)


def group_chunks(chunks: DataFrame) -> DataFrame:
    """One row a document: text_hash, patient_id (of the first chunk), chunks in order, failed."""
    status = F.col("chunk_status") if "chunk_status" in chunks.columns else F.lit("success")
    rows = chunks.withColumn("__status", status)
    return rows.groupBy("text_hash").agg(
        F.min_by("patient_id", "chunk_id").alias("patient_id"),
        F.sort_array(F.collect_list(F.struct("chunk_id", "char_offset_start", "entities"))).alias("chunks"),
        F.bool_or(F.col("__status") == "failed").alias("failed"),
    )


def reassemble(chunks: DataFrame, notes: DataFrame, model: str = "model", iou: float = 0.5) -> DataFrame:
    """Spans of whole documents from chunks(text_hash, patient_id, chunk_id, char_offset_start, entities).

    entities: array<struct<entity_group, score, word, start, end>>, offsets within the chunk. A document with a
    failed chunk has no spans. Documents without a note have an empty text; notes without chunks do not appear.
    """
    grouped = group_chunks(chunks)
    shifted = F.flatten(F.transform("chunks", lambda c: F.transform(c["entities"], lambda e: F.struct(e["entity_group"].alias("entity_type"), (e["start"] + c["char_offset_start"]).alias("start"), (e["end"] + c["char_offset_start"]).alias("end"), e["score"].alias("score"), F.lit(f"TransformersRecognizer[{model}]").alias("recognizer"), e["entity_group"].alias("pattern")))))
    spans = F.when(F.col("failed"), no_spans()).otherwise(suppress(F.coalesce(shifted.cast(SPANS), no_spans()), iou))
    texts = notes.dropDuplicates(["text_hash"]).select("text_hash", "note_text")
    out = grouped.join(texts, "text_hash", "left")
    return out.select("text_hash", "patient_id", F.coalesce("note_text", F.lit("")).alias("note_text"), spans.alias("spans")).withColumn("entity_count", F.size("spans"))


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Where the windows of a text of n characters begin; one at 0 if it is no longer than a window."""
    return F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap)))


def windows(docs: DataFrame, key: str, size: int = WINDOW, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Windows of long texts, and whole texts of others: key, offset, window."""
    starts = window_starts(F.length("note_text"), size, overlap)
    return docs.select(key, "note_text", F.explode(starts).alias("offset")).select(key, "offset", F.substring("note_text", F.col("offset") + 1, F.lit(size)).alias("window"))


def join_windows(found: DataFrame, key: str) -> DataFrame:
    """Spans of windows(key, offset, spans) in coordinates of the document, resolved by longest wins."""
    moved = F.transform("spans", lambda s: F.struct(s["entity_type"], (s["start"] + F.col("offset")).alias("start"), (s["end"] + F.col("offset")).alias("end"), s["score"], s["recognizer"], s["pattern"]))
    every = found.select(key, moved.cast(SPANS).alias("spans")).groupBy(key).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return every.select(key, longest_wins(by_position(F.array_distinct("spans"))).alias("spans"))


def merge_outputs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two recognizers' (text_hash, spans): all spans together, longest wins."""
    both = a.select("text_hash", F.col("spans").alias("a")).join(b.select("text_hash", F.col("spans").alias("b")), "text_hash", "full_outer")
    return both.select("text_hash", longest_wins(by_position(F.concat(F.coalesce("a", no_spans()), F.coalesce("b", no_spans())))).alias("spans"))
