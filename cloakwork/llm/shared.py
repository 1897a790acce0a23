"""Helpers that the operators of this subpackage share, besides those of the library."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cloakwork.sources.shared import cut, free_name, hot_join, shared_dir

__all__ = ["cut", "free_name", "hot_join", "partitions", "shared_dir"]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
