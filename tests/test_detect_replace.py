import datetime as dt
import hashlib
import hmac
import json
import re

import numpy as np
import model_stub
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cloakwork.functions.formats import all_formats, detect_format
from cloakwork.functions.keyed import Keys, accession_hash, keyed_index, patient_jitter
from cloakwork.operators import ages, bio, chunk, dates, detect, fake, fpe, known, llm_spans, locations, names
from cloakwork.operators.replace import Settings, anonymize
from cloakwork.plans import jobs
from cloakwork.schema import SPANS
from cloakwork.sources import io
from cloakwork.streaming import stream

cloudpickle.register_pickle_by_value(model_stub)  # workers cannot import it
KEYS = Keys.derive("test")


def spans_of(spark, text, f):
    r = spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("s")).first()
    return [(text[s["start"] : s["end"]], s["score"]) for s in r["s"]]


CASES = [
    (detect.email, "é\U0001f600 a.b+c@x-y.org, d@e.fr.", [("a.b+c@x-y.org", 0.85), ("d@e.fr", 0.85)]),
    (detect.phone, "call (555) 123-4567 ext 9 or 800-555-1234 or 555.123.4567", [("(555) 123-4567 ext 9", 0.7), ("800-555-1234", 0.7), ("555.123.4567", 0.7)]),
    (detect.ssn, "123-45-6780 000-12-3456 123456789 219099999 111111111", [("123-45-6780", 0.85), ("219099999", 0.3)]),
    (detect.ipv4, "at 10.0.0.255 and 300.1.1.1", [("10.0.0.255", 0.85)]),
    (detect.url, "see https://a.b/c?d=e). or www.x.org, y.com 1.2.3.4 fe80::1", [("https://a.b/c?d=e", 0.85), ("www.x.org", 0.8), ("y.com", 0.6), ("1.2.3.4", 0.85), ("fe80::1", 0.85)]),
    (detect.accession, "ACCESSION NUMBER: AB123456 and XY1234567", [("AB123456", 1.0), ("XY1234567", 0.3)]),
    (detect.har, "HAR : 1234567 har:99", [("1234567", 0.95), ("1234567", 0.95), ("99", 0.95)]),
    (detect.address, "lives at 456 Oak Ave, Oakland, CA 94612-1234 now", [("456 Oak Ave, Oakland, CA 94612-1234", 0.95)]),
    (detect.address, "PO Box 77, Reno, NV 89501", [("PO Box 77, Reno, NV 89501", 0.85)]),
    (detect.genetic, "x ACGTACGTACGTACGTACGTA y", [("ACGTACGTACGTACGTACGTA", 0.7)]),
    (detect.date, "on 03/15/2023, March 3rd, 2020 and 2020-01-02", [("03/15/2023", 0.6), ("March 3rd, 2020", 0.6), ("2020-01-02", 0.6)]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_detectors(spark, k):
    f, text, want = CASES[k]
    assert spans_of(spark, text, f) == want


def test_detectors_take_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    assert [len(r[0]) for r in df.select(detect.detect(F.col("t"), list(detect.DETECTORS))).collect()] == [0, 0]
    with pytest.raises(ValueError):
        detect.detect(F.col("t"), ["NOPE"])


def test_mrn_labels(spark):
    assert ("12345678", 0.95) in spans_of(spark, "MRN: 12345678 x", detect.mrn)
    assert ("555", 0.95) in spans_of(spark, "MED REC #:  555", detect.mrn)


def test_keyed_values_equal_hashlib(spark):
    ids = [f"p{i}é" for i in range(40)]
    df = spark.createDataFrame([(i,) for i in ids], "t string").select("t", keyed_index(F.col("t"), KEYS, 97).alias("k"), patient_jitter(F.col("t"), KEYS).alias("j"), accession_hash(F.col("t"), F.lit(" s ")).alias("h"))
    for r in df.collect():
        assert r["k"] == int.from_bytes(hashlib.sha256(KEYS.both + r["t"].encode()).digest()[:8]) % 97
        d = hmac.new(KEYS.both, b"date_jitter_v1:" + r["t"].encode(), "sha256").digest()
        n = int.from_bytes(d[:4]) % 178 + 3
        assert r["j"] == (n if d[4] % 2 == 0 else -n)
        assert r["h"] == hashlib.sha256(f"S|[U]|[E]|{r['t'].upper()}".encode()).hexdigest().upper()[:16]


@pytest.mark.parametrize(
    "text, jitter, want",
    [
        ("03/15/2023", 10, "03/25/2023"),
        ("3-5-2023", 1, "03-06-2023"),
        ("2023-03-15T15:11:00", 20, "2023-04-04"),
        ("15/Mar/2023", 10, "25/03/2023"),
        ("31/12/2022", 3, "03/01/2023"),
        ("March 1st, 2020", 30, "March 31st, 2020"),
        ("Mar of 2020", 20, "April of 2020"),
        ("March 10", 5, "March 15"),
        ("01/02/19", 3, "01/05/19"),
        ("12/30/85", 5, "01/04/86"),
        ("05/2020", 30, "06/2020"),
        ("2020/05", 30, "2020/06"),
        ("20080809", 3, "20080812"),
        ("Monday", 10, "Thursday"),
        ("mon", -1, "sun"),
        ("Monday, 2023-03-15", 3, "2023-03-18"),
        ("May", 9, "May"),
        ("1990s", 9, "1990s"),
        ("21w 1d", 9, "21w 1d"),
        ("02/30/2020", 3, "[DATE]"),
        ("nothing", 3, "[DATE]"),
        (None, 3, None),
    ],
)
def test_date_layouts(text, jitter, want):
    assert dates.shift_date(text, jitter, 2024) == want


def test_weekdays_and_checks(spark):
    r = spark.range(1).select(dates.rotate_weekday(F.lit("SUNDAY"), F.lit(3)).alias("a"), dates.rotate_weekday(F.lit("Tue"), F.lit(-3)).alias("b")).first()
    assert (r["a"], r["b"]) == ("WEDNESDAY", "Sat")
    with pytest.raises(ValueError):
        dates.check_jitter(2, "DATE")
    with pytest.raises(ValueError):
        dates.check_jitter(9, "AGE")


def test_ages(spark):
    want = {"95": "89", "64y": "64y", "95 yo": "89 yo", "Age: 101": "Age: 89", "ninety-five year old": "eighty-nine year old", "Ninety two year old": "Eighty nine year old", "45w2d": "42w2d", "29w2d": "29w2d", "100 months": "100 months", "hello": "hello", "six month old": "six month old"}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", ages.cap_age(F.col("t")).alias("x")).collect()} == want


def test_fpe_vectors_and_round_trip(spark):
    key, digits, letters = bytes.fromhex("EF4359D8D580AA4F7F036D6F04FC6A94"), "0123456789", "0123456789abcdefghijklmnop"
    vectors = [
        ("D8E7920AFA330A73", digits, "890121234567890000", "750918814058654607"),
        ("9A768A92F60E12D8", digits, "890121234567890000", "018989839189395384"),
        ("9A768A92F60E12D8", letters, "0123456789abcdefghi", "g2pk40i992fn20cjakb"),
    ]
    for tweak, alphabet, plain, cipher in vectors:
        row = spark.createDataFrame([(tweak, plain, cipher)], "w string, p string, c string").select(fpe.ff3(F.col("p"), key, F.col("w"), F.lit(alphabet)).alias("c"), fpe.ff3(F.col("c"), key, F.col("w"), F.lit(alphabet), True).alias("p")).first()
        assert (row["c"], row["p"]) == (cipher, plain)
    texts = ["(555) 123-4567", "123-45-6789", "MRN-12345678", "Ab12Cd34", "999-88-7777", "Zz9" * 10 + "zz", "9" * 56, "é12345-67"]
    df = spark.createDataFrame([(t,) for t in [*texts, "", "--", None, "12", "9" * 60]], "t string")
    rows = df.select("t", fpe.encrypt(F.col("t"), KEYS).alias("e")).select("t", "e", fpe.decrypt(F.col("e"), KEYS).alias("d")).collect()
    found = {r["t"]: r["e"] for r in rows}
    assert all(r["d"] == r["t"] for r in rows if r["t"] in texts)
    assert all(found[t] != t and re.sub("[0-9A-Za-z]", "x", found[t]) == re.sub("[0-9A-Za-z]", "x", t) for t in texts)
    assert (found[""], found["--"], found[None]) == ("", "--", None) and [len(found["12"]), len(found["9" * 60])] == [2, 64]


def test_fpe_of_arrays(spark):
    """The texts of an array go through each round together: nulls, texts without content, short, long and very long ones."""
    key, digits, letters = bytes.fromhex("EF4359D8D580AA4F7F036D6F04FC6A94"), "0123456789", "0123456789abcdefghijklmnop"
    vectors = [
        ("D8E7920AFA330A73", digits, "890121234567890000", "750918814058654607"),
        (None, digits, "890121234567890000", None),
        ("9A768A92F60E12D8", letters, "0123456789abcdefghi", "g2pk40i992fn20cjakb"),
        ("9A768A92F60E12D8", digits, None, None),
        ("D8E7920AFA330A73", digits, "89012123456789000000789000000", "48598367162252569629397416226"),
        ("9A768A92F60E12D8", digits, "890121234567890000", "018989839189395384"),
    ]
    kind = "array<struct<text: string, tweak: string, alphabet: string>>"
    for column, other, decrypt in ((2, 3, False), (3, 2, True)):
        df = spark.createDataFrame([([(v[column], v[0], v[1]) for v in vectors],)], f"i {kind}")
        assert df.select(fpe.ff3_all(F.col("i"), key, decrypt).alias("x")).first()["x"] == [v[other] if v[3] else None for v in vectors]
    content = digits + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = [None, "", "--", *("9" * n for n in range(1, 60, 4)), *("".join(content[i * n * 7 % 62] for i in range(n)) + "-Z" for n in range(1, 34))]
    df = spark.createDataFrame([(texts,)], "t array<string>").select("t", fpe.encrypt_all(F.col("t"), KEYS).alias("e"))
    row = df.select("t", "e", fpe.decrypt_all(F.col("e"), KEYS).alias("d")).first()
    single = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fpe.encrypt(F.col("t"), KEYS).alias("e")).collect()
    assert row["e"] == [r["e"] for r in sorted(single)]
    size = lambda t: len(re.sub("[^0-9A-Za-z]", "", t))
    assert all(d == t for t, d in zip(texts, row["d"]) if t is None or size(t) == 0 or (6 if re.sub("[^0-9A-Za-z]", "", t).isdigit() else 4) <= size(t) <= 32)


def test_rows_in_blocks_are_dealt_out(spark):
    """A file that is one task is dealt out, whole, in arrays that are neither long nor one a task."""
    rows = spark.range(0, 9000, 1, 1).select("id", F.col("id").cast("string").alias("t"))
    blocks = fpe.in_blocks(rows)
    assert blocks.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    found = blocks.select(F.spark_partition_id().alias("p"), "rows").collect()
    assert max(len(r["rows"]) for r in found) <= fpe.BLOCK and len({r["p"] for r in found}) > 1
    assert sorted(x["id"] for r in found for x in r["rows"]) == list(range(9000)) and all(x["t"] == str(x["id"]) for r in found for x in r["rows"])
    assert fpe.in_blocks(rows.limit(0)).count() == 0


def test_names_and_places():
    n = names.Namer(KEYS, names.default_names())
    assert n.replace("Dr. John van SMITH, MD").startswith("Dr. ") and n.replace("Dr. John van SMITH, MD").endswith(", MD") and " van " in n.replace("Dr. John van SMITH, MD")
    assert n.replace("John Smith") == n.replace("John") + " " + n.replace("Smith") and n.replace("SMITH") == n.replace("Smith").upper()
    assert n.replace("x") == "x" and n.replace("") == "" and n.replace(None) is None
    p = locations.Placer(KEYS)
    a = p.replace("456 Oak Ave, Oakland, CA 94612-1234")
    assert re.fullmatch(r"[0-9]{3} [A-Za-z ]+ Ave, [A-Za-z]+, CA [0-9]{5}-[0-9]{4}", a) and "Oakland" not in a
    assert p.replace("Reno, NV").endswith(", NV") and re.fullmatch("[0-9]{5}", p.replace("94305"))
    assert p.replace("General Hospital") == p.replace("General Hospital") != "General Hospital"


def test_formats(spark):
    want = {"123": "DIGITS", "abc": "LOWERCASE", "ABC": "UPPERCASE", "abc123": "HEX_LOWER", "xyz123": "ALPHANUMERIC_LOWER", " 12": "LEADING_SPACE_DIGITS", "(555) 123-4567": "PHONE_US", "123-45-6789": "SSN", "a@b.co": "EMAIL", "10.0.0.1": "IP_ADDRESS", "https://a.b": "URL_HTTPS", "www.a.org": "URL_WWW_PREFIX", "a.org": "URL_DOMAIN_ONLY", "1/2/2020": "DATE_MDY", "12345-6789": "ZIP_CODE", "29w2d": "HEX_LOWER", "?!": None}
    want["29w2d"] = "ALPHANUMERIC_LOWER"
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", detect_format(F.col("t")).alias("x")).collect()} == want
    assert df.where("t = '123'").select(all_formats(F.col("t")).alias("x")).first()["x"][0] == "DIGITS"


def test_known_values_and_dictionary(spark):
    ids = {"person": ["Smith, Anna", "x"], "mrn": ["12345"], "location": ["Palo", "Alto"]}
    text = "anna smith of Palo Alto, id 12345; Smithson"
    df = spark.createDataFrame([(text, ids), (None, None)], "t string, ids map<string, array<string>>")
    rows = df.select(known.known_values(F.col("t"), F.col("ids")).alias("s")).collect()
    found = sorted((s["entity_type"], text[s["start"] : s["end"]]) for s in rows[0]["s"])
    assert found == [("LOCATION", "Palo Alto"), ("MRN", "12345"), ("PATIENT", "Smith"), ("PATIENT", "anna smith")] and rows[1]["s"] == []
    config = {"institution": "X", "rules": [{"pattern": "Oak", "score": 0.6, "category": "location"}, {"pattern": "Oak Clinic", "score": 0.9, "category": "facility"}]}
    got = known.Dictionary(config).spans("at Oak Clinic.")
    assert [(s["entity_type"], s["start"], s["end"]) for s in got] == [("HOSPITAL", 3, 13)]
    for bad in ({"flags": ["NOPE"]}, {"score": 2}, {"pattern": "("}):
        with pytest.raises(ValueError):
            known.Dictionary({"institution": "X", "rules": [{"pattern": "a", "score": 0.5, **bad}]})


def test_llm_reply(spark):
    reply = '```json\n{"P": [{"text": "ab", "confidence": 0.7}, {"text": "ab", "confidence": 0.1}], "Q": [{"text": "abc"}]}\n```'
    df = spark.createDataFrame([("ab abc ab", reply), ("x", "no json"), ("x", None)], "t string, r string")
    rows = [[(s["entity_type"], s["start"], s["end"], s["score"]) for s in r["s"]] for r in df.select(llm_spans.located(F.col("t"), F.col("r")).alias("s")).collect()]
    assert rows == [[("P", 0, 2, 0.7), ("Q", 3, 6, 0.9), ("P", 7, 9, 0.7)], [], []]
    out = llm_spans.recognize(spark.createDataFrame([("h", "ab")], "text_hash string, note_text string"), "find", lambda: (lambda p: 1 / 0), attempts=2, wait=0.0).first()
    assert out["processing_status"] == "failed" and out["spans"] == []


def test_chunks(spark):
    def plan(n, c, o):
        if c <= o:
            o = c // 2
        if n // 4 < c:
            return [(0, n)]
        return [(s, min(s + 4 * c, n)) for s in range(0, n - 4 * o, 4 * (c - o))]

    for c, o in ((8, 2), (4, 9), (16, 0)):
        for n in (0, 1, 4 * c - 1, 4 * c, 4 * c + 1, 200):
            r = spark.range(1).select(chunk.plan_chunks(F.lit(n), c, o).alias("p")).first()["p"]
            assert [(x["start"], x["end"]) for x in r] == plan(n, c, o), (n, c, o)


def test_reassembly_and_failed_chunks(spark):
    entities = "array<struct<entity_group: string, score: double, word: string, start: int, end: int>>"
    rows = [("h", "p", 0, 0, [("A", 0.9, "", 1, 4)], "success"), ("h", "p", 1, 3, [("A", 0.8, "", 0, 1), ("B", 0.7, "", 2, 5)], "success"), ("g", "p", 0, 0, [("A", 0.9, "", 0, 1)], "failed")]
    chunks = spark.createDataFrame(rows, f"text_hash string, patient_id string, chunk_id int, char_offset_start int, entities {entities}, chunk_status string")
    notes = spark.createDataFrame([("h", "0123456789"), ("h", "0123456789")], "text_hash string, note_text string")
    got = {r["text_hash"]: r for r in chunk.reassemble(chunks, notes).collect()}
    assert [(s["entity_type"], s["start"], s["end"]) for s in got["h"]["spans"]] == [("A", 1, 4), ("A", 3, 4), ("B", 5, 8)]
    assert got["g"]["spans"] == [] and got["g"]["note_text"] == ""


def test_bio_words(spark):
    rows = [(1, 0, 3, "B-A", 0.6, "x"), (1, 3, 5, "I-B", 0.9, "x"), (1, 6, 9, "B-A", 0.5, "Ġy"), (1, 20, 22, "I-A", 0.7, "z")]
    df = spark.createDataFrame(rows, "id long, start int, end int, entity string, score double, word string")
    got = [(r["start"], r["entity"]) for r in bio.normalise(df, "id").orderBy("start").collect()]
    assert got == [(0, "B-B"), (3, "I-B"), (6, "B-A"), (20, "I-A")]
    spans = [(r["entity_group"], r["start"], r["end"]) for r in bio.aggregate(bio.normalise(df, "id"), "id").orderBy("start").collect()]
    assert spans == [("B", 0, 5), ("A", 6, 9), ("A", 20, 22)]
    r = spark.range(1).select(bio.parse_tokens(F.lit("oops")).alias("x"), bio.parse_tokens(F.lit('[{"entity":"B-A","score":1,"start":0,"end":1}]')).alias("y")).first()
    assert r["x"]["chunk_status"] == "failed" and r["y"]["chunk_status"] == "success" and len(r["y"]["tokens"]) == 1


def test_replacement_end_to_end(spark):
    notes = spark.createDataFrame([("mail a@b.co on 03/15/2023 from 10.0.0.1 to (555) 123-4567.", "p1"), (None, "p2"), ("clean", None), ("clean", None)], "note_text string, patient_uid string")
    rows = jobs.pipeline(notes, Settings(KEYS, 2024), jobs.ModelConfig("rule", model_stub.tagger), ["EMAIL_ADDRESS", "DATE_TIME", "IP_ADDRESS", "PHONE"]).collect()
    assert len(rows) == 4
    by = {r["patient_uid"]: r for r in rows}
    out = by["p1"]["anonymized_note_text"]
    assert not re.search(r"a@b\.co|03/15/2023|10\.0\.0\.1|\(555\) 123-4567", out) and re.search(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}\.$", out) and "@example.com" in out
    assert all(out[i["start"] : i["end"]] == i["text"] for i in by["p1"]["items"])
    shifted = dt.datetime.strptime(re.search(r"[0-9/]{10}", out)[0], "%m/%d/%Y").date()
    assert 3 <= abs((shifted - dt.date(2023, 3, 15)).days) <= 180
    assert by["p2"]["anonymized_note_text"] is None and by["p2"]["processing_status"] == "skipped"
    assert by[None]["anonymized_note_text"] == "clean"
    with pytest.raises(ValueError):
        Settings(KEYS, 2024, {"A": "nope"})


def test_fake_values(spark):
    kinds = ["EMAIL_ADDRESS", "PHONE", "GENETIC_SEQUENCE", "IP_ADDRESS", "AGE", "ZZZ"]
    text = ["a@b.co", "555-123-4567", "ACGT" * 20, "1.2.3.4", "44", "q"]
    shape = [r"[a-p]{8}@example\.com", r"[0-9]{3}-[0-9]{3}-[0-9]{4}", "[ACGT]{80}", r"203\.0\.113\.[0-9]+", "[0-9]{2}", "[0-9]{8}"]
    df = spark.createDataFrame(list(zip(kinds, text)), "e string, t string").select("t", fake.fake(F.col("e"), F.col("t"), KEYS).alias("f"))
    a, b = df.collect(), df.collect()
    assert a == b and all(re.fullmatch(s, r["f"]) for s, r in zip(shape, a))


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "n1.txt").write_text("a\nb")
    assert [(r["note_id"], r["note_text"]) for r in io.read_text_folder(spark, str(tmp_path / "t")).collect()] == [("n1", "a\nb")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "k1.json").write_text(json.dumps({"key": "k", "recognizer_results": [{"start": 1, "end": 2, "entity_type": "A"}]}))
    (tmp_path / "s" / "k2.json").write_text(json.dumps({"response": [{"span_start": 3, "span_end": 4, "pii_type": "B", "score": 0.5}]}))
    assert sorted(tuple(r) for r in io.read_span_files(spark, str(tmp_path / "s")).collect()) == [("k", 1, 2, "A", 0.9), ("k2", 3, 4, "B", 0.5)]
    (tmp_path / "n.json").write_text(json.dumps([{"note_text": "x", "patient_identifiers": {"mrn": ["1"]}}, {"note_text": "y"}]))
    rows = {r["note_text"]: r for r in io.notes_from_json(spark, str(tmp_path / "n.json")).collect()}
    assert json.loads(rows["x"]["patient_identifiers"]) == {"mrn": ["1"]} and rows["y"]["text_hash"] == hashlib.sha256(b"y").hexdigest()
    with pytest.raises(ValueError):
        io.read_table(spark, "a.txt")
    df = spark.createDataFrame([("h", "t")], "Hash string, TEXT string")
    assert io.resolve_aliases(df, ["text_hash", "note_text"]).columns == ["text_hash", "note_text"]
    assert io.input_pattern("a") == "a/*.parquet" and io.input_pattern("a/*.x") == "a/*.x"


def test_resume_and_cli(spark, tmp_path):
    from cloakwork import cli

    notes = spark.createDataFrame([(f"h{i}", f"mail u{i}@x.org") for i in range(6)], "text_hash string, note_text string")
    notes.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    job = lambda d: jobs.recognize(d, ["EMAIL_ADDRESS"]).select("text_hash", "entity_count")
    assert jobs.run_resumed(notes.limit(2), job, out, "text_hash") == 2
    assert jobs.run_resumed(notes, job, out, "text_hash") == 6
    assert cli.run(["recognizer", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "rec"), "--entities", "EMAIL_ADDRESS"], spark) == 0
    KEYS.save(str(tmp_path / "salt"), str(tmp_path / "key"))
    assert cli.run(["pipeline", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "pipe"), "--salt", str(tmp_path / "salt"), "--key", str(tmp_path / "key"), "--entities", "EMAIL_ADDRESS"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "pipe")).where("anonymized_note_text like '%@x.org%'").count() == 0
    with pytest.raises(SystemExit):
        cli.options(["pipeline", "-i", "a", "-o", "b"])
    with pytest.raises(jobs.EmptyOutput):
        jobs.guard(notes.limit(0), True)


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"x u{i}@y.org 10.0.0.{i}") for i in range(20)], "doc_id long, text string")
    path = str(tmp_path / "docs")
    docs.repartition(3).write.parquet(path)
    rows = stream.mask_documents(stream.read_stream(spark, path, docs.schema, 1))
    stream.run_available(rows, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(stream.mask_documents(docs).collect())


def test_row_status_survives_bad_rows(spark):
    df = spark.createDataFrame([(None, "not json"), ("a@b.co", None)], "note_text string, recognizer_results_json string")
    rows = jobs.recognize(df, ["EMAIL_ADDRESS"]).collect()
    assert [r["processing_status"] for r in rows] == ["skipped", "success"] and [r["entity_count"] for r in rows] == [0, 1]
    assert anonymize(spark.createDataFrame([], f"text_hash string, note_text string, spans {SPANS}"), Settings(KEYS, 2024)).collect() == []
