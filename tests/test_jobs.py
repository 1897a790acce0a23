"""Jobs on notes: texts that patients share, models that are asked, failed rows, large notes."""

import datetime as dt
import re
import time

import model_stub
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cloakwork import cli
from cloakwork.functions.keyed import Keys
from cloakwork.operators import chunk, detect, llm_spans
from cloakwork.operators import spans as sp
from cloakwork.operators.replace import Settings, anonymize, splice
from cloakwork.plans import jobs
from cloakwork.schema import ITEMS, SPANS, text_hash

KEYS = Keys.derive("test")
cloudpickle.register_pickle_by_value(model_stub)  # workers cannot import it


@pytest.mark.parametrize("keyed", ["text_hash", None])
def test_patients_who_share_a_text_keep_their_own_values(spark, keyed):
    text = "seen 01/02/2020 by Anna Miller ok"
    notes = spark.createDataFrame([(text, "p1", 10), (text, "p2", -20), (text, None, None), (text, "p1", 10)], "note_text string, patient_uid string, jitter int")
    if keyed:
        notes = notes.withColumn("text_hash", text_hash(F.col("note_text")))
    person = F.array(F.struct(F.lit("PERSON").alias("entity_type"), F.lit(19).alias("start"), F.lit(30).alias("end"), F.lit(0.9).alias("score"), F.lit("r").alias("recognizer"), F.lit("p").alias("pattern")))
    rows = anonymize(notes.withColumn("spans", F.concat(detect.date(F.col("note_text")), person.cast(SPANS))), Settings(KEYS, 2024)).collect()
    assert len(rows) == 4
    names = set()
    for r in rows:
        m = re.fullmatch(r"seen ([0-9/]{10}) by ([A-Za-z]+ [A-Za-z]+) ok", r["anonymized_note_text"])
        days = (dt.datetime.strptime(m[1], "%m/%d/%Y").date() - dt.date(2020, 1, 2)).days
        assert days == r["jitter"] if r["jitter"] else 3 <= abs(days) <= 180
        assert r["entity_count"] == 2 and all(r["anonymized_note_text"][i["start"] : i["end"]] == i["text"] for i in r["items"])
        names.add(m[2])
    assert len(names) == 1 and "Anna Miller" not in names


def test_replacement_moves_no_rows(spark):
    notes = spark.createDataFrame([("h", "x", [])], f"text_hash string, note_text string, spans {SPANS}")
    plan = anonymize(notes, Settings(KEYS, 2024))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_own_lists_are_used(spark):
    notes = spark.createDataFrame([("Anna Miller in Oakland, CA", [("PERSON", 0, 11, 0.9, "r", "p"), ("LOCATION", 15, 26, 0.9, "r", "p")])], f"note_text string, spans {SPANS}")
    out = anonymize(notes, Settings(KEYS, 2024, names=("Zoe",), cities=("Hereford",))).first()
    assert out["anonymized_note_text"] == "Zoe Zoe in Hereford, CA"


def test_splice_equals_a_loop(spark):
    text = "é\U0001f600 one two three four"
    items = [(0, 1, "A", "xyz", "o"), (3, 6, "B", "", "o"), (6, 7, "C", "--", "o"), (17, 21, "D", "\U0001f600", "o")]
    r = spark.createDataFrame([(text, items), (text, [])], f"t string, i {ITEMS}").select(splice(F.col("t"), F.col("i")).alias("s")).collect()
    want, at = "", 0
    for a, b, _, new, _ in items:
        want, at = want + text[at:a] + new, b
    want += text[at:]
    assert r[0]["s"]["text"] == want and [want[i["start"] : i["end"]] for i in r[0]["s"]["items"]] == [x[3] for x in items]
    assert r[1]["s"]["text"] == text


def test_notes_with_many_spans(spark):
    """Notes of 1,000 disjoint spans take less than a second each, and 2,000 overlapping ones some seconds."""

    def resolved(notes, n, size):
        made = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.lit("A").alias("entity_type"), (i * 10).cast("int").alias("start"), (i * 10 + size).cast("int").alias("end"), F.lit(0.5).alias("score"), F.lit("r").alias("recognizer"), F.lit("p").alias("pattern")))
        rows = spark.range(notes).select(made.cast(SPANS).alias("spans")).repartition(1)
        t = time.time()
        found = rows.select(F.size(sp.resolve_results(F.col("spans"))).alias("n")).collect()
        return time.time() - t, {r["n"] for r in found}

    took, n = resolved(10, 1000, 5)
    assert n == {1000} and took < 10
    took, n = resolved(1, 2_000, 15)
    assert n == {1_000} and took < 20


def test_long_notes_are_asked_in_windows(spark):
    text = " ".join(f"w{i} secret{i}" for i in range(60))
    notes = spark.createDataFrame([("a", text), ("b", "boom"), ("c", None), ("d", "plain")], "text_hash string, note_text string")
    rows = {r["text_hash"]: r for r in llm_spans.recognize(notes, "find", model_stub.load, attempts=1, wait=0.0, size=100, overlap=20).collect()}
    assert {text[s["start"] : s["end"]] for s in rows["a"]["spans"]} == {f"secret{i}" for i in range(60)}
    assert [rows[k]["processing_status"] for k in "abcd"] == ["success", "failed", "skipped", "success"] and rows["b"]["spans"] == []


def test_failed_rows_are_taken_again(spark, tmp_path):
    notes = spark.createDataFrame([(str(i), "boom" if i % 3 == 0 else f"a secret{i}") for i in range(9)], "text_hash string, note_text string")
    out = str(tmp_path / "out")
    job = lambda load: lambda d: llm_spans.recognize(d, "find", load, attempts=1, wait=0.0)
    assert jobs.run_resumed(notes, job(model_stub.load), out, "text_hash") == 6
    assert jobs.run_resumed(notes, job(model_stub.load), out, "text_hash") == 6
    assert jobs.run_resumed(notes, job(model_stub.mended), out, "text_hash") == 9


def test_llm_jobs_of_the_command_line(spark, tmp_path):
    spark.createDataFrame([("h", "mail a@b.co secret1"), ("g", "none")], "text_hash string, note_text string").write.parquet(str(tmp_path / "in"))
    (tmp_path / "prompt.txt").write_text("find secrets")
    KEYS.save(str(tmp_path / "salt"), str(tmp_path / "key"))
    at = lambda x: str(tmp_path / x)
    ask = ["--llm", "model_stub:load", "--prompt", at("prompt.txt")]
    assert cli.run(["llm-recognizer", "-i", at("in"), "-o", at("llm"), *ask], spark) == 0
    assert spark.read.parquet(at("llm")).select(F.sum(F.size("spans"))).first()[0] == 1
    base = ["pipeline", "-i", at("in"), "--salt", at("salt"), "--key", at("key"), "--entities", "EMAIL_ADDRESS", *ask]
    for mode, gone in (("only", ["secret1"]), ("merge", ["secret1", "a@b.co"]), ("off", ["a@b.co"])):
        assert cli.run([*base, "-o", at(mode), "--llm-mode", mode, "--stages", at(f"{mode}-stages")], spark) == 0
        text = " ".join(r["anonymized_note_text"] for r in spark.read.parquet(at(mode)).collect())
        assert {w for w in ("secret1", "a@b.co") if w not in text} == set(gone)
        assert spark.read.parquet(at(f"{mode}-stages/recognized")).count() == 2
    with pytest.raises(SystemExit):
        cli.options(["llm-recognizer", "-i", "a", "-o", "b"])


def test_texts_from_chunks(spark):
    texts = ["", "short", "é\U0001f600x" * 400, "a b " * 999]
    notes = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "text_hash string, note_text string")
    got = {r["text_hash"]: r["note_text"] for r in chunk.whole_texts(chunk.chunk_documents(notes, 16, 4)).collect()}
    assert got == {str(i): t for i, t in enumerate(texts)}
