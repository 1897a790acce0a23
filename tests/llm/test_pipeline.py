"""Each stage of the pipeline against brute force on what the stage before it kept."""

import os

import pytest
from llm_texts import prose
from test_neardup import brute
from test_quality_secrets_mixing import brute_spans
from test_tokens_packing_records import check_packed, ids_by_doc

import corpus_pipeline
from cloakwork.llm import mixing, packing, quality
from cloakwork.llm.shared import cut

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), "test")
        seen.append(docs)
        if stage is not corpus_pipeline.pack:
            assert docs.columns == columns
    first, unique, clean, mixed, packed = seen
    source = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"] for r in quality.judge(source).collect() if r["kept"]}
    assert {r["doc_id"] for r in first.collect()} == want and first.count() == len(want)
    groups = brute([(r["doc_id"], r["text"]) for r in first.collect()], 5)
    assert {r["doc_id"] for r in unique.collect()} == set(groups.values())
    before = {r["doc_id"]: r for r in unique.collect()}
    for r in clean.collect():
        old = before[r["doc_id"]]
        spans = brute_spans(old["text"])
        assert (r["text"] == old["text"]) == (not spans) and not brute_spans(r["text"]) and r["lang"] == old["lang"]
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, clean.collect()))
    place = {r["doc_id"]: r["place"] for r in mixing.mix(clean.select("doc_id", "source")).collect()}
    order = [place[r["doc_id"]] for r in corpus_pipeline.mix_sources(spark, clean, SF).collect()]
    assert order == sorted(order)
    check_packed(packed.collect(), ids_by_doc(mixed.collect(), "byte", 0))


def test_empty_and_odd_documents(spark, odd, none):
    for docs, some in ((odd, True), (none, False)):
        for name, stage in corpus_pipeline.STAGES:
            out = cut(stage(spark, docs, SF), "test")
            if name != "packing":
                assert out.columns == docs.columns
            docs = out
        assert (docs.count() > 0) is some


def test_sequences_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, prose(i, 30 + 400 * (i % 7 == 0)), "abc"[min(2, i % 5)]) for i in range(600)], "doc_id long, text string, source string")
    place = {r["doc_id"]: r["place"] for r in mixing.mix(docs).collect()}
    out = corpus_pipeline.pack(spark, cut(corpus_pipeline.mix_sources(spark, docs, SF), "test"), SF).collect()
    parts = {}
    for r in out:
        if r["sequence_id"] < packing.MERGED:
            parts.setdefault(r["sequence_id"] >> packing.PART_BITS, set()).add(place[r["doc_id"]])
    order = [parts[p] for p in sorted(parts)]
    assert len(order) > 1 and all(max(a) < min(b) for a, b in zip(order, order[1:]))
