"""Continuing an output without reading all of it.

An output lies in folders by a few bits of its key's hash. Beside it stands a table of finished pairs: an input file (its
path, size and time) and a bucket, all of whose rows are in the output. A run leaves out the rows of finished pairs
without looking at the output, and reads only the key column, and only of those buckets that some input file has not
finished. Rows that a job gives no result for keep their pair unfinished, so that the next run takes them again.

Defined cases: rows that come from no file are never finished, so their keys are looked up; a file that changes is
another file; a null key is a key; an output that was written without buckets is continued without them, and its keys
are read as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of an output: a task that writes has a file in each.
BUCKETS, BUCKET, FILE = 16, "key_bucket", "__file"


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def finished_path(path: str) -> str:
    return f"{path.rstrip('/')}.finished"


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def with_files(df: DataFrame) -> DataFrame:
    """df with the file that each row came from; null if it came from none."""
    name = F.concat_ws("|", *(F.col(f"_metadata.{c}").cast("string") for c in ("file_path", "file_size", "file_modification_time")))
    try:
        return df.select("*", name.alias(FILE))
    except AnalysisException:
        return df.withColumn(FILE, F.lit(None).cast("string"))


def without(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys done lacks; nulls are equal to each other."""
    names = [f"__done_{k}" for k in keys]
    done = done.select(*(F.col(k).alias(n) for k, n in zip(keys, names))).distinct()
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    return rows.join(done, same, "left_anti")


def open_pairs(rows: DataFrame, path: str) -> tuple[DataFrame, list[int]]:
    """rows (with their file and bucket) of pairs that are not finished, and the buckets that those may be in."""
    finished = read_if_there(rows.sparkSession, finished_path(path))
    if finished is None:
        return rows, list(range(BUCKETS))
    every = F.array(*(F.lit(b) for b in range(BUCKETS)))
    done = finished.groupBy(F.col("file").alias("__f")).agg(F.collect_set("bucket").alias("done"))
    files = rows.select(FILE).distinct().join(done, F.col(FILE) == F.col("__f"), "left")
    left = files.select(F.explode(F.array_except(every, F.coalesce("done", F.array().cast("array<int>")))).alias("b")).distinct()
    touched = sorted(r["b"] for r in left.collect())
    return without(rows, finished.select(F.col("file").alias(FILE), F.col("bucket").alias(BUCKET)), [FILE, BUCKET]), touched


def left_to_do(df: DataFrame, path: str, key: str) -> tuple[DataFrame, DataFrame, list[int] | None]:
    """The rows of df that the output at path lacks (with their file and bucket), the rows of open pairs, and the touched
    buckets; None for those if the output has no buckets."""
    rows = with_files(df).withColumn(BUCKET, bucket_of(key))
    out = read_if_there(df.sparkSession, path)
    if out is None:
        return rows, rows, []
    if BUCKET not in out.columns:
        return without(rows, out, [key]), rows, None
    rows, touched = open_pairs(rows, path)
    # of the output, the key column of these folders alone is read
    return without(rows, out.where(F.col(BUCKET).isin(touched)), [BUCKET, key]) if touched else rows.limit(0), rows, touched


def continued(df: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, key: str) -> int:
    """Run job on the rows of df whose key the output at path lacks, append what it gives, and return the output's rows.

    job keeps the column key, and leaves out rows that have failed.
    """
    spark = df.sparkSession
    todo, rows, touched = left_to_do(df, path, key)
    result = job(todo.select(*df.columns))
    if touched is None:
        result.write.mode("append").option("compression", "zstd").parquet(path)
    else:
        result.withColumn(BUCKET, bucket_of(key)).write.mode("append").option("compression", "zstd").partitionBy(BUCKET).parquet(path)
        _mark(rows, path, key)
    out = read_if_there(spark, path)
    return out.count() if out is not None else 0


def _mark(rows: DataFrame, path: str, key: str) -> None:
    """Note the pairs of rows whose keys are all in the output now."""
    spark = rows.sparkSession
    out = read_if_there(spark, path)
    pairs = rows.where(F.col(FILE).isNotNull()).select(FILE, BUCKET, key)
    if out is None or pairs.isEmpty():
        return
    missing = without(pairs, out, [BUCKET, key])
    done = without(pairs.select(FILE, BUCKET).distinct(), missing, [FILE, BUCKET])
    done.select(F.col(FILE).alias("file"), F.col(BUCKET).alias("bucket")).coalesce(1).write.mode("append").parquet(finished_path(path))
