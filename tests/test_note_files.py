"""One file a note: round trips, tasks that run again, failures, many small files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cloakwork.operators.detect import detect
from cloakwork.schema import ITEMS, SPANS
from cloakwork.sources import io, note_files


def _files(path):
    return {f: open(f"{path}/{f}", encoding="utf-8").read() for f in os.listdir(path) if not f.endswith(".crc")}


def test_round_trip(spark, tmp_path):
    notes = spark.createDataFrame([(f"h{i}", f"ä mail u{i}@x.org") for i in range(50)] + [("none", None)], "text_hash string, note_text string")
    found = notes.withColumn("spans", detect(F.col("note_text"), ["EMAIL_ADDRESS"])).withColumn("other", F.lit(1))
    path = str(tmp_path / "rec")
    for _ in range(2):  # the second run replaces the first
        note_files.write_recognizer_files(found.repartition(5), path)
    files = _files(path)
    assert sorted(files) == sorted([*(f"h{i}.json" for i in range(50)), "none.json"])
    assert json.loads(files["h7.json"])["value"] == "ä mail u7@x.org" and json.loads(files["none.json"]) == {"key": "none", "value": "", "recognizer_results": []}
    assert os.listdir(tmp_path) == ["rec"]
    got = io.read_span_files(spark, path)
    want = io.span_table(found).drop("recognizer_name")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() == 50


def test_many_small_files_share_partitions(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").cast("string").alias("text_hash"), F.lit("x").alias("note_text"), F.array().cast(SPANS).alias("spans"))
    note_files.write_recognizer_files(rows, str(tmp_path / "many"))
    df = io.read_span_files(spark, str(tmp_path / "many"))
    assert len(_files(tmp_path / "many")) == 400 and df.rdd.getNumPartitions() <= 400 // 20


def test_a_task_that_runs_again_leaves_no_second_file(spark, tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"name": ["a.json", "b.json"], "body": ["1", "2"]})
    for overwrite in (True, False):
        path = str(tmp_path / str(overwrite))
        w = note_files.FileWriter(path, overwrite)

        def broken():
            yield batch
            raise RuntimeError("lost")

        with pytest.raises(RuntimeError):
            w.write(broken())
        open(f"{w.folder}/.killed.part", "w").close() if overwrite else None
        assert w.write(iter([batch])).rows == 2
        w.commit([note_files.Written(2)])
        assert _files(path) == {"a.json": "1", "b.json": "2"}


def test_failure_keeps_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    one = spark.createDataFrame([("a", "x", [])], f"row_id string, anonymized_note_text string, items {ITEMS}")
    note_files.write_anonymizer_files(one, path)
    bad = one.withColumn("anonymized_note_text", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        note_files.write_anonymizer_files(bad, path)
    assert _files(path) == {"a.json": '{"text":"x","items":[]}'} and os.listdir(tmp_path) == ["out"]
    note_files.write_anonymizer_files(one.withColumn("row_id", F.lit("b")), path, mode="append")
    assert sorted(_files(path)) == ["a.json", "b.json"]
    note_files.write_anonymizer_files(one.limit(0), path)
    assert _files(path) == {}


def test_names(spark, tmp_path):
    keys = ["a", "A.b-c", "", None, "../x", "x/y", ".h", "%null", "ä", "k" * 300]
    df = spark.createDataFrame([(k, f"{i}") for i, k in enumerate(keys)], "k string, t string")
    note_files.write_note_files(df, str(tmp_path / "n"), "k", F.col("t"))
    files = _files(tmp_path / "n")
    assert sorted(files.values()) == sorted(str(i) for i in range(len(keys))) and {"a.json", "A.b-c.json", "%null.json"} <= set(files)
    assert os.listdir(tmp_path) == ["n"]


def test_two_notes_of_one_key(spark, tmp_path):
    same = spark.createDataFrame([("k", "1"), ("k", "2"), ("k", "1")], "k string, t string").coalesce(1)
    with pytest.raises(Exception, match="two different notes"):
        note_files.write_note_files(same, str(tmp_path / "n"), "k", F.col("t"))
    note_files.write_note_files(same, str(tmp_path / "n"), "k", F.col("t"), distinct=True)
    assert sorted(_files(tmp_path / "n").values()) == ["1", "2"]


def test_viewer_files_of_a_job(spark, tmp_path):
    from cloakwork import cli
    from cloakwork.functions.keyed import Keys

    rows = [(f"mail u{i}@x.org", f"p{i}") for i in range(4)] + [("mail u0@x.org", "other")]
    spark.createDataFrame(rows, "note_text string, patient_uid string").write.parquet(str(tmp_path / "in"))
    Keys.derive("test").save(str(tmp_path / "salt"), str(tmp_path / "key"))
    assert cli.run(["pipeline", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--salt", str(tmp_path / "salt"), "--key", str(tmp_path / "key"), "--viewer", str(tmp_path / "v"), "--entities", "EMAIL_ADDRESS"], spark) == 0
    found = [json.loads(t) for t in _files(tmp_path / "v" / "recognizer").values()]
    assert sorted(f["value"] for f in found) == sorted(t for t, _ in rows) and all(len(f["recognizer_results"]) == 1 for f in found)
    made = [json.loads(t) for t in _files(tmp_path / "v" / "anonymizer").values()]
    assert len(made) == 5 and all("@x.org" not in m["text"] and len(m["items"]) == 1 for m in made)
