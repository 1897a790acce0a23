"""A patient's automaton, built once for many notes, and samples that do not depend on partitions."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from cloakwork.operators import known
from cloakwork.plans import catalogue
from cloakwork.sources import io

NOTES = "id long, patient_uid string, note_text string"


def test_notes_of_patients(spark, monkeypatch):
    monkeypatch.setattr(known, "NOTES", 10)
    texts = ["seen Anna Miller, mrn 12345", "nothing", None, "", "12345 12345", "ANNA"]
    rows = [(i, f"p{i % 3}" if i % 7 else None, texts[i % len(texts)]) for i in range(90)] + [(90, "p0", texts[0])] * 2
    ids = [("p0", {"person": ["Miller, Anna"], "mrn": ["12345"]}), ("p1", {"mrn": ["9"], "person": None}), ("p0", {"mrn": ["nothing"]}), ("p9", {"mrn": ["12345"]})]
    notes = spark.createDataFrame(rows, NOTES)
    patients = spark.createDataFrame(ids, "patient_uid string, identifiers map<string, array<string>>")
    out = known.known_by_patient(notes, patients)
    assert out.columns == [*notes.columns, "spans"] and out.count() == 92
    merged = {"person": ["Miller, Anna"], "mrn": ["12345", "nothing"]}
    for r in known.known_by_patient(notes, patients, merge=False).collect():
        want = known.hits(r["note_text"] or "", merged) if r["patient_uid"] == "p0" else []
        assert [(s["entity_type"], s["start"], s["end"]) for s in r["spans"]] == want
    one = out.where("id = 90").first()
    assert [(s["entity_type"], s["start"], s["end"]) for s in one["spans"]] == [("MRN", 22, 27), ("PATIENT", 5, 16)]
    assert known.known_by_patient(notes.limit(0), patients).count() == 0


def test_an_automaton_serves_all_notes_of_a_part(monkeypatch):
    built = []
    make = known.automaton
    monkeypatch.setattr(known, "automaton", lambda *a: built.append(a[0]) or make(*a))
    kind = pa.list_(pa.struct([("key", pa.string()), ("value", pa.list_(pa.string()))]))
    rows = []
    for p in ("a", "b"):
        for salt in (0, 1):
            rows += [(p, salt, 0, [{"key": "mrn", "value": ["12"]}], None, None)] + [(p, salt, 1, None, {"x": i}, "12 and 12") for i in range(50)]
    columns = list(zip(*rows))
    as_entries = pa.array(columns[3], kind)
    whole = pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2]), as_entries, pa.array(columns[4]), pa.array(columns[5])], ["patient", "salt", "place", "identifiers", "row", "text"])
    out = list(known._by_patient(frozenset())(whole.slice(i, 30) for i in range(0, len(rows), 30)))
    assert len(built) == 4 and sum(b.num_rows for b in out) == 200
    assert all(len(s) == 2 for b in out for s in b.column(1).to_pylist())


def test_occurrences_of_a_value_that_overlap(spark, tmp_path):
    """Masking takes all of them; the query counts as its SQL does, also on nulls and on letters whose lower case is longer."""
    assert known.hits("ontiontion", {"mrn": ["ontion"]}) == [("MRN", 0, 6), ("MRN", 4, 10)]
    assert known.occurrences(known.automaton({"mrn": ["ontion", "nti"]}), "Ontiontiontion", False) == [("MRN", 0, 6), ("MRN", 1, 4), ("MRN", 5, 8), ("MRN", 8, 14), ("MRN", 9, 12)]
    rows = [(1, 0, "Ontion, tretre"), (1, 1, "ontiontion tretretre tretretretre"), (2, 0, None), (2, 1, "abcabcabc abcdef"), (2, 2, "abcabcabcabcdefabc"), (3, None, "zzzzzz"), (3, 1, "yyyyyy"), (3, 2, "yyyyyyyyyyyyy zzzzzz"), (4, 0, "İstanbul"), (4, 0, "istanbul"), (4, 1, "İSTANBULİstanbul"), (None, 0, "nobody nobody")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, catalogue.queries()["known_values_by_patient"](spark, str(tmp_path)).collect()), key=str)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert got == sorted(db.execute(catalogue.oracle_sql()["known_values_by_patient"]).fetchall(), key=str) and (1, 1, "ontion", 1) in got


def test_bottom_k(spark):
    df = spark.range(3000).select("id", (F.col("id") % 700).alias("key"), (F.col("id") % 3).cast("string").alias("g"))
    one, many = (sorted(map(tuple, io.bottom_k(df.repartition(n), 40, "key", seed=3).collect())) for n in (1, 64))
    assert one == many and len(one) == 40 and all(i < 700 for i, _, _ in one)
    parts = io.bottom_k(df.where("id < 1000"), 40, "key", seed=3).unionByName(io.bottom_k(df.where("id >= 1000"), 40, "key", seed=3))
    assert sorted(map(tuple, io.bottom_k(parts, 40, "key", seed=3).collect())) == one
    by = io.bottom_k(df, 5, "key", by=("g",)).groupBy("g").count().collect()
    assert {r["count"] for r in by} == {5} and len(by) == 3
    assert io.bottom_k(df.select(F.lit(None).cast("long").alias("key")), 5, "key").count() == 0
