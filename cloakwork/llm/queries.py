"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import audit, chat, clusters, fingerprints, langid, mixing, neardup, oracle, packing, quality, records, secrets, sharding, urlrules
from cloakwork.llm.shared import shared_dir

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), "byte", end_id=0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return chat.parse(rows.drop("role"), chat.learn(rows))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return urlrules.judge(table(spark, sf_dir, "pages"), labels)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rule"] < secrets.BASE)
    counts = [_count(k).alias(f"n_{secrets.RULES[k].kind}") for k in range(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def _count(rule: int) -> Column:
    n = F.size(F.filter("spans", lambda s: s["rule"] == rule))
    return F.when(F.col("spans").isNull(), 0).otherwise(n).cast("long")


def op9_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = records.write(table(spark, sf_dir, "documents"), shared_dir(spark, "records"), public_tokenizers.path(WORD_BPE), "word", end_id=1)
    return records.read(spark, shards)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_packing, op3_quality, op4_chat, op5_neardup, op6_langid, op7_urlrules, op8_secrets, op9_records, op10_mixing, op11_sharding, op12_clusters, op13_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality": oracle.QUALITY, "op5_neardup": oracle.NEARDUP, "op7_urlrules": oracle.URLRULES, "op8_secrets": oracle.SECRETS, "op10_mixing": oracle.MIXING, "op12_clusters": oracle.CLUSTERS, "op13_audit": oracle.AUDIT}
