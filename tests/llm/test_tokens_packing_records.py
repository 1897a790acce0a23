import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakwork.llm import packing, records
from cloakwork.llm.shared import shared_dir
from cloakwork.llm.tokens import Encoder

PATHS = {"byte": public_tokenizers.path("byte_bpe_50k.json"), "word": public_tokenizers.path("word_bpe_49k.json")}
TEXT = st.text(st.one_of(st.sampled_from(list("ab eE'st.,\n\t0 <|>ÉßİΣς　\x1c\x85")), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.mark.parametrize("kind", PATHS)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, max_size=4))
def test_encoder_equals_the_tokenizer(kind, texts):
    e = Encoder.of(PATHS[kind], kind)
    ids, per = e.encode(texts)
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert per.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_encoder_joins_plain_words():
    e = Encoder(PATHS["byte"], "byte")
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdeéß") for _ in range(r.randint(1, 12))) for _ in range(3000))
    assert e.encode([text])[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_chunk_is_looked_up_once_a_call(monkeypatch):
    """Looking up each occurrence was a third of the time of packing."""
    e = Encoder(PATHS["byte"], "byte")
    looked_up, look_up = [], e._look_up
    monkeypatch.setattr(e, "_look_up", lambda cache, prefix, chunks: looked_up.extend(chunks) or look_up(cache, prefix, chunks))
    words = [f"w{i % 50}" for i in range(20_000)]
    texts = [" ".join(words), "\n".join(words), "", " ", "w1 ", " w1", "w1\n", "\nw1"] + [f"a{chr(i)}{chr(i)}b c{chr(i)}d" for i in (32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000)]
    ids, per = e.encode(texts)
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert per.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(looked_up) < 200
    parts = list(e.encode_slices(texts, 30))
    assert [x for a, b, _, _ in parts for x in range(a, b)] == list(range(len(texts))) and len(parts) > 4
    assert np.concatenate([p for *_, p in parts]).tolist() == per.tolist() and np.concatenate([i for _, _, i, _ in parts]).tolist() == ids.tolist()


def check_packed(rows, ids_of):
    """Every id of every document lies in one piece, checksums hold, and sequences have no gaps."""
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 1024
    for doc, options in ids_of.items():
        got = sorted(by_doc[doc], key=lambda p: p["start"])
        assert sum(p["length"] for p in got) == sum(map(len, options))
        for p in got:
            assert any(len(i) == p["doc_tokens"] and zlib.crc32(i[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for i in options)
    return by_seq


def ids_by_doc(rows, kind, end):
    t = Encoder.of(PATHS[kind], kind).tokenizer
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, end], "<u4"))
    return out


def test_packing_odd_rows(odd, none):
    rows = packing.pack(odd, PATHS["byte"]).collect()
    check_packed(rows, ids_by_doc(odd.collect(), "byte", 0))
    assert packing.pack(none, PATHS["byte"]).collect() == []


def test_packing_merges_what_partitions_leave(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('word ', cast(id % 90 AS int)) AS text").repartition(7)
    rows = packing.pack(docs, PATHS["byte"], windows=3, group=4).collect()
    by_seq = check_packed(rows, ids_by_doc(docs.collect(), "byte", 0))
    short = [s for s, p in by_seq.items() if sum(x["length"] for x in p) < 1024]
    assert len(short) <= 2  # one for each four partitions


def test_records_round_trip(odd, none, spark):
    folder = shared_dir(spark, "records")
    shards = records.write(odd, folder, PATHS["word"])
    rows = records.read(spark, shards).collect()
    want = ids_by_doc(odd.collect(), "word", 1)
    assert len(rows) == odd.count()
    for r in rows:
        assert any(len(i) == r["n_tokens"] and zlib.crc32(i.tobytes()) == r["ids_crc32"] for i in want[r["doc_id"]])
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted((r["doc_id"] for r in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    empty = records.write(none, shared_dir(spark, "records"), PATHS["word"])
    assert empty == [] and records.read(spark, empty).collect() == []
    picked = records.read_at(shards[0]["path"], list(range(shards[0]["docs"]))[::-1])
    assert len(picked) == shards[0]["docs"] and all(ids[-1] == 1 for _, ids in picked)


def test_damage_is_found(tmp_path):
    data = records.frame(records.payload(7, np.array([1, 2, 3]), 2))
    path = tmp_path / "a.bin"
    for i in range(len(data)):
        path.write_bytes(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
        with path.open("rb") as f, pytest.raises(ValueError):
            list(records.read_records(f))
    path.write_bytes(data[:-1])
    with path.open("rb") as f, pytest.raises(ValueError):
        list(records.read_records(f))


def test_records_of_a_large_vocabulary(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"[U]": 0, "far": 70_000, "low": 5}, unk_token="[U]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "t.json"))
    docs = spark.createDataFrame([(None, f"far low {'low ' * i}") for i in range(40)], "doc_id long, text string")
    shards = records.write(docs, shared_dir(spark, "records"), str(tmp_path / "t.json"), "whole", end_id=1)
    assert len(shards) > 1  # rows of one id are split
    want = sorted(zlib.crc32(np.array([70_000, 5, *[5] * i, 1], "<u4").tobytes()) for i in range(40))
    assert sorted(r["ids_crc32"] for r in records.read(spark, shards).collect()) == want
    assert all(70_000 in records.read_at(s["path"], [0])[0][1] for s in shards)
