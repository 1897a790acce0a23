"""A corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes what its predecessor kept, written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import mixing, neardup, packing, quality, secrets
from cloakwork.llm.shared import cut, partitions


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8), the one with the smallest doc_id stays."""
    return neardup.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; all documents stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves their sources by weight."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 1024 tokens, which are filled in the order of the schedule.

    Files keep that order in their names and rows, but readers do not: documents are dealt by ranges of file and row.
    """
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    try:
        rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # not read from files: rows come in the order that docs has
        return packing.pack(docs, tokenizer, "byte", end_id=0)
    number = [F.regexp_extract("file", p, 1).try_cast("long") for p in (r"^part-([0-9]+)", r"-c([0-9]+)[.]")]
    order = [*number, F.col("file"), F.col("row")]
    ordered = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    return packing.pack(ordered.select("doc_id", "text"), tokenizer, "byte", end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs


#: Tokenizing and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None
