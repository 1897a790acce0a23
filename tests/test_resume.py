"""Outputs that are continued: by rows, by files and buckets, and by the command line."""

import re

import pytest
from pyspark.sql import functions as F

from cloakwork import cli
from cloakwork.functions.keyed import Keys
from cloakwork.operators.replace import Settings
from cloakwork.plans import jobs
from cloakwork.sources import io, resume

KEYS = Keys.derive("test")


def notes(spark, ids):
    return spark.createDataFrame([(i, f"text {i}") for i in ids], "id long, note_text string")


def job(bad=()):
    """A job whose rows fail for some ids."""
    return lambda d: d.withColumn("processing_status", F.when(F.col("id").isin(list(bad)), "failed").otherwise("success"))


def test_rows_are_those_of_the_anti_join(spark, tmp_path):
    at = str(tmp_path / "in")
    out = str(tmp_path / "out")
    notes(spark, range(40)).repartition(3).write.parquet(at)
    assert jobs.run_resumed(spark.read.parquet(at), job([3, 5, 8]), out, "id") == 37
    todo = resume.left_to_do(spark.read.parquet(at), out, "id")[0]
    assert sorted(r["id"] for r in todo.collect()) == [3, 5, 8]
    anti = io.remaining(spark.read.parquet(at), spark.read.parquet(out), "id")
    assert sorted(r["id"] for r in anti.collect()) == [3, 5, 8]
    notes(spark, range(30, 60)).write.mode("append").parquet(at)
    assert jobs.run_resumed(spark.read.parquet(at), job([50]), out, "id") == 59
    assert jobs.run_resumed(spark.read.parquet(at), job(), out, "id") == 60
    rows = spark.read.parquet(out)
    assert sorted(r["id"] for r in rows.collect()) == list(range(60)) and rows.where(F.col(resume.BUCKET) != resume.bucket_of("id")).isEmpty()


def test_only_touched_folders_are_read(spark, tmp_path):
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    notes(spark, range(200)).coalesce(1).write.parquet(at)
    jobs.run_resumed(spark.read.parquet(at), job([7]), out, "id")
    todo, _, touched = resume.left_to_do(spark.read.parquet(at), out, "id")
    bucket = notes(spark, [7]).select(resume.bucket_of("id")).first()[0]
    assert touched == [bucket]
    plan = todo._jdf.queryExecution().executedPlan().toString()
    read = next(line for line in plan.splitlines() if "FileScan" in line and "key_bucket#" in line)
    assert re.search(rf"PartitionFilters: \[[^\]]*key_bucket[^\]]*{bucket}", read) and "ReadSchema: struct<id:bigint>" in read
    jobs.run_resumed(spark.read.parquet(at), job(), out, "id")
    todo, _, touched = resume.left_to_do(spark.read.parquet(at), out, "id")
    assert touched == [] and todo.isEmpty()


def test_files_that_change_and_null_keys(spark, tmp_path):
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "id long, note_text string")
    first.coalesce(1).write.parquet(at)
    assert jobs.run_resumed(spark.read.parquet(at), job(), out, "id") == 3
    assert jobs.run_resumed(spark.read.parquet(at), job(), out, "id") == 3
    notes(spark, [1, 2]).coalesce(1).write.mode("overwrite").parquet(at)
    assert jobs.run_resumed(spark.read.parquet(at), job(), out, "id") == 4


def test_rows_from_no_file_and_outputs_without_buckets(spark, tmp_path):
    out = str(tmp_path / "out")
    notes(spark, range(3)).write.parquet(out)
    assert jobs.run_resumed(notes(spark, range(5)), lambda d: d, out, "id") == 5
    out = str(tmp_path / "other")
    assert jobs.run_resumed(notes(spark, range(3)), lambda d: d, out, "id") == 3
    assert jobs.run_resumed(notes(spark, range(5)), lambda d: d, out, "id") == 5
    assert jobs.run_resumed(notes(spark, []), lambda d: d, str(tmp_path / "none"), "id") == 0


def files(tmp_path):
    KEYS.save(str(tmp_path / "salt"), str(tmp_path / "key"))
    return ["--salt", str(tmp_path / "salt"), "--key", str(tmp_path / "key")]


@pytest.mark.parametrize("name", ["pipeline", "anonymizer"])
def test_the_same_command_twice_appends_nothing(spark, tmp_path, name):
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    # one text of two patients is two rows
    rows = [("mail a@b.co", "p1"), ("mail a@b.co", "p2"), ("none", None), (None, "p3")]
    df = spark.createDataFrame(rows, "note_text string, patient_uid string")
    if name == "anonymizer":
        df = df.withColumns({"text_hash": F.sha2("note_text", 256), "recognizer_results_json": F.lit("[]")})
    df.write.parquet(at)
    command = [name, "-i", at, "-o", out, *files(tmp_path), "--resume", *(["--entities", "EMAIL_ADDRESS", "--stages", str(tmp_path / "stages")] if name == "pipeline" else [])]
    for _ in range(2):
        assert cli.run(command, spark) == 0
        done = spark.read.parquet(out)
        assert done.count() == 4 and done.select("row_id").distinct().count() == 4
    spark.createDataFrame([("mail c@d.co", "p1")], "note_text string, patient_uid string").withColumns({} if name == "pipeline" else {"text_hash": F.sha2("note_text", 256), "recognizer_results_json": F.lit("[]")}).write.mode("append").parquet(at)
    assert cli.run(command, spark) == 0
    assert spark.read.parquet(out).count() == 5


def test_steps_can_be_left_out(spark, tmp_path):
    ids = '{"person": ["Miller"]}'
    df = spark.createDataFrame([("mail a@b.co to Miller", ids)], "note_text string, patient_identifiers string")
    found = lambda *skip: {s["entity_type"] for s in jobs.pipeline(df, None, entities=["EMAIL_ADDRESS"], skip=[*skip, "anonymizer"]).first()["spans"]}
    assert found() == {"EMAIL_ADDRESS", "PATIENT"} and found("known") == {"EMAIL_ADDRESS"} and found("detectors") == {"PATIENT"} and found("known", "detectors") == set()
    with pytest.raises(ValueError):
        jobs.pipeline(df, Settings(KEYS, 2024), skip=["nothing"])
    df.write.parquet(str(tmp_path / "in"))
    assert cli.run(["pipeline", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--skip", "anonymizer", "known"], spark) == 0
    assert "anonymized_note_text" not in spark.read.parquet(str(tmp_path / "out")).columns
