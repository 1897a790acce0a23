"""The folder that driver and executors share, tables written there, and joins on keys that may be hot."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster shares.

    The folder is the session's spark.checkpoint.dir. Only a local master without that setting (tests) gets a
    temporary folder of its own; on a cluster a missing setting is an error, since executors share no local disk.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cloakwork-')}"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later steps start from the files, whatever
    executor is lost, and never compute df again."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """A column name that clashes with none of columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on a key that may be hot on the left.

    The right side usually comes from an aggregation on the same key. Joining on a hash of the key, too, makes Spark
    deal out both sides by exchanges of their own, whose skewed partitions adaptive execution may split; with the
    aggregation's own partitioning it could not.
    """
    k = free_name([*left.columns, *right.columns], "__k")
    return left.withColumn(k, F.xxhash64(key)).join(right.withColumn(k, F.xxhash64(key)), [k, key], how).drop(k)
