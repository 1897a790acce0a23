"""The same transformations on streams: masking and recognition row by row, windows over events, resuming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakwork.operators.detect import detect
from cloakwork.operators.replace import mask_text
from cloakwork.operators.spans import resolve_results


def read_stream(spark: SparkSession, path: str, schema, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def mask_documents(docs: DataFrame, entities: Sequence[str] = ("EMAIL_ADDRESS", "PHONE", "IP_ADDRESS"), text: str = "text") -> DataFrame:
    """docs with masked text and entity_count; works on batches and streams alike."""
    spans = resolve_results(detect(F.col(text), entities))
    return docs.withColumn("__s", spans).withColumns({text: mask_text(F.col(text), F.col("__s")), "entity_count": F.size("__s")}).drop("__s")


def drop_repeats(docs: DataFrame, key: str, time: str, within: str = "1 hour") -> DataFrame:
    """The first row of each key within a bounded time; state is dropped behind the watermark."""
    return docs.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling or sliding windows."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "user_id", "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there now as Parquet, once; a later call goes on where this one ended."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
