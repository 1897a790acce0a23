"""Jobs: recognition, tagging, reassembly, replacement, and the whole pipeline as one lazy plan."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.operators import bio, chunk, detect, known, llm_spans
from cloakwork.operators.replace import Settings, anonymize
from cloakwork.operators.spans import by_position, longest_wins
from cloakwork.schema import require_columns, row_id, text_hash
from cloakwork.sources import io, resume
from cloakwork.sources.shared import hot_join

ENTITIES = ("EMAIL_ADDRESS", "PHONE", "US_SSN", "URL", "IP_ADDRESS", "ACC_NUM", "HAR", "MRN", "LOCATION", "BASE64_IMAGE", "GENETIC_SEQUENCE", "DATE_TIME")


class EmptyOutput(RuntimeError):
    """No rows came from an input that had some."""


@dataclass(frozen=True)
class ModelConfig:
    """A tagger: chunk and overlap in tokens, labels to ignore, its label map, and its ID label with a multiplier."""

    name: str
    load: Callable[[], bio.Model]
    chunk: int = 512
    overlap: int = 40
    ignored: tuple[str, ...] = ("O",)
    labels: Mapping[str, str] | None = None
    id_label: str | None = None
    id_multiplier: float = 1.0


def recognize(notes: DataFrame, entities: Sequence[str] = ENTITIES, resolve: bool = False, stopwords: Sequence[str] = (), cached_types: Sequence[str] | None = None) -> DataFrame:
    """notes(note_text[, text_hash, patient_identifiers, recognizer_results_json]) with spans.

    Detectors, cached results (of cached_types, by default the entities) and known values together; resolve: longest
    wins. A null text has no spans and the
    status "skipped"; no row is dropped.
    """
    require_columns(notes, ["note_text"])
    spans = detect.detect(F.col("note_text"), entities)
    if "recognizer_results_json" in notes.columns:
        spans = F.concat(spans, detect.cached(F.col("recognizer_results_json"), [*(entities if cached_types is None else cached_types), *known.KINDS.values()]))
    if "patient_identifiers" in notes.columns:
        spans = F.concat(spans, known.known_values(F.col("note_text"), io.identifiers(), stopwords))
    if resolve:
        spans = longest_wins(by_position(spans))
    out = notes if "text_hash" in notes.columns else notes.withColumn("text_hash", text_hash(F.col("note_text")))
    out = out.withColumn("spans", spans)
    null = F.col("note_text").isNull()
    return out.withColumns({"entity_count": F.size("spans"), "processing_status": F.when(null, "skipped").otherwise("success"), "error_message": F.when(null, "note_text is null")})


def recognize_long(notes: DataFrame, entities: Sequence[str] = ENTITIES, size: int = chunk.WINDOW, overlap: int = chunk.WINDOW_OVERLAP) -> DataFrame:
    """text_hash and spans; texts longer than size are searched in windows, and their spans resolved."""
    found = chunk.windows(notes.dropDuplicates(["text_hash"]), "text_hash", size, overlap).select("text_hash", "offset", detect.detect(F.col("window"), entities).alias("spans"))
    return chunk.join_windows(found, "text_hash")


def tag(notes: DataFrame, model: ModelConfig) -> DataFrame:
    """Chunks of notes with the tagger's entities: text_hash, patient_id, chunk_id, char_offset_start, entities."""
    chunks = chunk.chunk_documents(notes, model.chunk, model.overlap)
    tokens = chunks.withColumn("tokens", bio.dedupe_tokens(bio.tag(F.col("chunk_text"), model.load, model.ignored)))
    flat = tokens.select("chunk_uid", "chunk_text", F.explode("tokens").alias("t")).select("chunk_uid", "chunk_text", "t.*")
    entities = bio.aggregate(bio.normalise(flat, "chunk_uid", "chunk_text").drop("chunk_text"), "chunk_uid")
    packed = entities.groupBy("chunk_uid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "entity_group", "score"))).alias("e"))
    shaped = F.transform("e", lambda x: F.struct(x["entity_group"].alias("entity_group"), x["score"].cast("double").alias("score"), F.lit("").alias("word"), x["start"].alias("start"), x["end"].alias("end")))
    none = F.array().cast("array<struct<entity_group: string, score: double, word: string, start: int, end: int>>")
    return chunks.join(packed, "chunk_uid", "left").select("text_hash", "patient_id", "chunk_id", "char_offset_start", F.coalesce(shaped, none).alias("entities"))


def reassemble(chunks: DataFrame, notes: DataFrame, model: ModelConfig) -> DataFrame:
    out = chunk.reassemble(chunks, notes, model.name)
    return out.withColumn("spans", bio.map_labels(F.col("spans"), dict(model.labels), model.id_label, model.id_multiplier)) if model.labels else out


def identified(notes: DataFrame) -> DataFrame:
    """notes with lower-case names, text_hash, patient_uid (null if missing) and row_id, by which runs are resumed."""
    base = notes.toDF(*(c.lower() for c in notes.columns))
    own = text_hash(F.col("note_text"))
    base = base.withColumn("text_hash", F.coalesce("text_hash", own) if "text_hash" in base.columns else own)
    if "patient_uid" not in base.columns:
        base = base.withColumn("patient_uid", F.lit(None).cast("string"))
    return base.withColumn("row_id", row_id(F.col("text_hash"), F.col("patient_uid")))


#: What a pipeline can do without.
STEPS = ("detectors", "known", "cached", "tagger", "anonymizer")


def pipeline(
    notes: DataFrame,
    settings: Settings | None,
    model: ModelConfig | None = None,
    entities: Sequence[str] = ENTITIES,
    llm: Callable[[], Callable[[str], str]] | None = None,
    prompt: str = "",
    llm_mode: str = "off",
    stages: str | None = None,
    skip: Sequence[str] = (),
) -> DataFrame:
    """Tag, detect, ask a model, resolve, replace. llm_mode: off, only (the model's spans alone) or merge. skip: steps
    of STEPS to leave out; without the anonymizer the rows come with their spans.

    One lazy plan. stages: a folder where the tagger's, the model's and all spans are written as tables tagged, asked and
    recognized, a folder for each run, from which the later steps read.
    """
    if llm_mode not in ("off", "only", "merge"):
        raise ValueError("llm_mode is off, only or merge")
    if unknown := set(skip) - set(STEPS):
        raise ValueError(f"no such steps: {sorted(unknown)}; there are {STEPS}")
    if settings is None and "anonymizer" not in skip:
        raise ValueError("the anonymizer needs settings")
    base = identified(notes)
    sources = base
    for step, column in (("known", "patient_identifiers"), ("cached", "recognizer_results_json")):
        if (step in skip or llm_mode == "only") and column in sources.columns:
            sources = sources.drop(column)
    found = recognize(sources, () if "detectors" in skip or llm_mode == "only" else entities, cached_types=entities).drop("entity_count", "processing_status", "error_message")
    extra = []
    run = f"run={uuid.uuid4().hex}"

    def staged(df: DataFrame, name: str) -> DataFrame:
        if stages is None:
            return df
        path = f"{stages.rstrip('/')}/{name}/{run}"
        io.write_parquet(df, path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    if model and llm_mode != "only" and "tagger" not in skip:
        tagged = staged(reassemble(tag(base.dropDuplicates(["text_hash"]), model), base, model).select("text_hash", "spans"), "tagged")
        extra.append(tagged.select("text_hash", F.col("spans").alias("__model")))
    if llm and llm_mode != "off":
        asked = staged(llm_spans.recognize(base.dropDuplicates(["text_hash"]).select("text_hash", "note_text"), prompt, llm), "asked")
        extra.append(asked.select("text_hash", F.col("spans").alias("__llm")))
    for e in extra:
        name = e.columns[1]
        # very many notes may share a text, such as an empty one
        found = hot_join(found, e, "text_hash", "left").withColumn("spans", F.concat("spans", F.coalesce(name, F.slice("spans", 1, 0)))).drop(name)
    found = staged(found, "recognized")
    return found if "anonymizer" in skip else anonymize(found, settings)


def guard(output: DataFrame, had_input: bool) -> DataFrame:
    """output, or EmptyOutput if it has no rows though there was input."""
    if had_input and output.isEmpty():
        raise EmptyOutput("no rows came out of an input that had some")
    return output


def run_resumed(df: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, key: str) -> int:
    """Run job on rows whose key the output at path lacks, and append; the number of rows now there.

    Rows that fail are left out of the output, so that the next run takes them again.
    """
    return resume.continued(df, lambda d: without_failed(job(d)), path, key)


def without_failed(out: DataFrame) -> DataFrame:
    return out.where("processing_status <> 'failed'") if "processing_status" in out.columns else out


def dry_run(df: DataFrame, required: Sequence[str], job: Callable[[DataFrame], DataFrame]) -> str:
    """Check columns and return the plan; nothing runs."""
    require_columns(df, required)
    return job(df)._jdf.queryExecution().toString()
