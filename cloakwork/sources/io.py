"""Sources and sinks: Parquet, JSON, CSV, text folders, span files, and resuming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.schema import IDENTIFIERS, SPANS, text_hash
from cloakwork.sources.shared import free_name

ALIASES = {
    "text_hash": ("text_hash", "hash", "note_id", "id"),
    "note_text": ("note_text", "text", "text_content", "note"),
    "recognizer_results_json": ("recognizer_results_json", "recognizer_results", "results", "spans"),
    "anonymized_note_text": ("anonymized_note_text", "anonymized_text", "deid_text"),
}


def input_pattern(path: str) -> str:
    """A glob, a Parquet file or a folder as it is; anything else is a folder of Parquet files."""
    return path if "*" in path or path.endswith((".parquet", "/")) else f"{path}/*.parquet"


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, recursive: bool = False, merge_schemas: bool = False) -> DataFrame:
    """Files, folders (recursive on request) or globs, through Spark's reader, so that any store works. merge_schemas
    reads the footer of every file first; without it all files have the columns of one."""
    reader = spark.read.option("mergeSchema", str(merge_schemas).lower())
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.parquet(*([path] if isinstance(path, str) else sorted(path)))
    return df.select(*columns) if columns else df


def read_pipeline(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, recursive: bool = False, merge_schemas: bool = False) -> DataFrame:
    """Parquet with lower-case names."""
    df = read_parquet(spark, path, recursive=recursive, merge_schemas=merge_schemas)
    df = df.toDF(*(c.lower() for c in df.columns))
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "zstd") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def notes_from_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON notes with hash, ids and identifiers filled in, in one order of columns."""
    df = spark.read.option("multiLine", "true").json(path)
    have = set(df.columns)
    col = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
    identifiers = F.to_json("patient_identifiers") if "patient_identifiers" in have and dict(df.dtypes)["patient_identifiers"] != "string" else col("patient_identifiers", F.lit("{}"))
    null = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    return df.select(
        F.col("note_text"),
        col("text_hash", text_hash(F.col("note_text"))).alias("text_hash"),
        col("patient_id", F.lit("")).cast("string").alias("patient_id"),
        F.coalesce(identifiers, F.lit("{}")).alias("patient_identifiers"),
        null("patient_uid", "string").alias("patient_uid"),
        null("jitter", "int").alias("jitter"),
        col("recognizer_results_json", F.lit("[]")).alias("recognizer_results_json"),
    )


def read_text_folder(spark: SparkSession, path: str) -> DataFrame:
    """note_id (the file's stem) and note_text of every .txt file."""
    df = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return df.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("note_id"), F.col("value").alias("note_text"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV or Parquet by the name's ending."""
    if path.endswith(".csv"):
        return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"neither CSV nor Parquet: {path}")


def read_lines(spark: SparkSession, path: str, column: str = "value") -> DataFrame:
    """A list with one entry a line, without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias(column)).where(f"{column} <> '' AND NOT startswith({column}, '#')").distinct()


def read_span_files(spark: SparkSession, path: str, default_score: float = 0.9) -> DataFrame:
    """Span table from JSON files of either format: {key, recognizer_results: [{start, end, entity_type, score}]} or
    {response: [{span_start, span_end, pii_type, score}]}; the file's stem is the note unless key says so."""
    a = "array<struct<start: int, end: int, entity_type: string, score: double>>"
    b = "array<struct<span_start: int, span_end: int, pii_type: string, score: double>>"
    df = spark.read.schema(f"key string, recognizer_results {a}, response {b}").option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    note = F.coalesce("key", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    other = F.transform("response", lambda r: F.struct(r["span_start"].alias("start"), r["span_end"].alias("end"), r["pii_type"].alias("entity_type"), r["score"].alias("score")))
    rows = df.select(note.alias("note_id"), F.explode(F.coalesce("recognizer_results", other)).alias("s"))
    return rows.select("note_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.entity_type").alias("span_tag"), F.coalesce("s.score", F.lit(default_score)).alias("score"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold spans: a JSON array of {span_start, span_end, span_tag, text} a file; the stem is the note."""
    df = spark.read.schema("span_start int, span_end int, span_tag string, text string").option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    return df.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("note_id"), "*")


def span_objects(spans: str | Column) -> Column:
    """Spans in the layout of result files."""
    return F.transform(spans, lambda s: F.struct(s["entity_type"], s["start"], s["end"], s["score"], F.struct(s["recognizer"].alias("recognizer_name"), s["pattern"].alias("matched_pattern")).alias("recognition_metadata")))


def spans_to_json(spans: str = "spans") -> Column:
    return F.to_json(span_objects(spans))


def span_table(df: DataFrame, key: str = "text_hash", spans: str = "spans") -> DataFrame:
    """Long span table of a recognized frame."""
    rows = df.select(F.col(key).alias("note_id"), F.explode(F.col(spans).cast(SPANS)).alias("s"))
    return rows.select("note_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.entity_type").alias("span_tag"), F.col("s.score").alias("score"), F.col("s.recognizer").alias("recognizer_name"))


def resolve_aliases(df: DataFrame, wanted: Sequence[str], aliases: dict[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Columns under their proper names, whichever of their aliases df has."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for name in wanted:
        found = next((have[a] for a in aliases.get(name, (name,)) if a in have), None)
        if found is None:
            raise ValueError(f"no column for {name}; there are {df.columns}")
        out.append(F.col(found).alias(name))
    return df.select(*out)


def sample_rows(df: DataFrame, limit: int, total: int | None = None, where: str | None = None, ids: Sequence[str] | None = None, key: str | None = None, seed: int = 0) -> DataFrame:
    """A bounded sample for looking at results: filtered, sampled at twice the needed rate (0.1 % at least), one row a
    key, limited."""
    if where:
        df = df.where(where)
    if ids is not None:
        df = df.where(F.col(key or "text_hash").isin(list(ids)))
    elif total:
        df = df.sample(min(max(2 * limit / total, 0.001), 1.0), seed=seed)
    return (df.dropDuplicates([key]) if key else df).limit(limit)


def bottom_k(df: DataFrame, k: int, key: str, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Of each group by, the rows of the k keys with the smallest SHA-256 of seed:key, one row a key: its first in the
    order of df's columns. The same rows whatever the partitions, and samples of parts merge: that of a union is the
    sample of the parts' samples. Each task keeps k keys a group before rows meet. A null key is not sampled."""
    rank, nth = (free_name(df.columns, n) for n in ("__rank", "__nth"))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256)
    few = df.where(F.col(key).isNotNull()).withColumn(rank, F.dense_rank().over(Window.partitionBy(*by).orderBy(h, key))).where(F.col(rank) <= k)
    first = Window.partitionBy(*by, key).orderBy(*df.columns)
    return few.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*df.columns)


def row_count(df: DataFrame, where: str | None = None) -> int:
    return (df.where(where) if where else df).count()


def identifiers(column: str = "patient_identifiers"):
    """The known-value map of a JSON column; null or bad JSON gives an empty map."""
    return F.coalesce(F.from_json(column, IDENTIFIERS), F.create_map().cast(IDENTIFIERS))


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key the output doesn't have yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def write_metrics(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", "true").csv(path) if kind == "csv" else writer.json(path)
