"""The whole pipeline next to the brute-force versions of its stages."""

from __future__ import annotations

import zlib
from collections import defaultdict

import pytest
from test_near_duplicates_stage import kept_by_hand

import corpus_pipeline
from galley.llm import packing, rule_ensemble, secret_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("steps") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_stages(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "packing"]
    columns = steps[0][0].asDict().keys()
    assert all(r.asDict().keys() == columns for step in steps[1:4] for r in step)


def test_quality_keeps_what_the_model_accepts(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = rule_ensemble.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in rule_ensemble.score_documents(docs, model).where("score >= 0.3").collect()}
    assert {r.doc_id for r in steps[1]} == want
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, y in labels.items() if y == 1]
    assert sum(i in want for i in good) >= 0.95 * len(good)


def test_one_document_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1]]
    assert sorted(r.doc_id for r in steps[2]) == kept_by_hand(rows)
    assert {tuple(r) for r in steps[2]} <= {tuple(r) for r in steps[1]}


def test_no_secret_is_left_and_the_rest_is(spark, steps):
    before, after = {r.doc_id: r for r in steps[2]}, {r.doc_id: r for r in steps[3]}
    assert before.keys() == after.keys()
    frame = spark.createDataFrame(steps[2])
    spans = {r.doc_id: r.spans for r in secret_scan.with_spans(frame).collect()}
    for i, old in before.items():
        if not spans[i]:
            assert after[i].text == old.text
        for s in spans[i]:
            assert old.text[s["start"] : s["end"]] not in after[i].text
        assert after[i].n_chars == len(after[i].text)


def test_all_text_is_packed(steps):
    texts = {r.doc_id: packing.token_ids(r.text, "byte_bpe_50k.tiktoken") for r in steps[3]}
    pieces = defaultdict(list)
    for r in steps[4]:
        pieces[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(texts[r.doc_id][r.start : r.start + r.length].tobytes())
    assert {i: sum(r.length for r in p) for i, p in pieces.items()} == {i: len(t) for i, t in texts.items()}


def test_run_equals_the_stages(spark, steps):
    got = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()}
    whole = defaultdict(int)
    for i, _, n, _ in got:
        whole[i] += n
    assert whole == {i: sum(r.length for r in steps[4] if r.doc_id == i) for i in {r.doc_id for r in steps[4]}}
