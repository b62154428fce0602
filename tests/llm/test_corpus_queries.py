"""The registered corpus queries and the pipeline over whole small tables."""

import os
import zlib

import corpus_pipeline
import plain
import pytest
from checking import compare, duck

from teleloom.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"


def rows(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF) == ""


def test_phrases(spark):
    docs = [(d.doc_id, d.text) for d in rows(spark, "documents")]
    got = {tuple(x) for x in QUERIES["op2_phrase_dedup"](spark, SF).collect()}
    assert got == {(i, n, gone, plain.sha(left)) for i, n, gone, left in plain.phrases(docs)}


def test_simhash(spark):
    docs = [(d.doc_id, d.text) for d in rows(spark, "documents")]
    assert {tuple(x) for x in QUERIES["op6_simhash_dedup"](spark, SF).collect()} == plain.simhash(docs)


def test_languages_of_unseen_documents(spark):
    lang = {d.doc_id: d.lang for d in rows(spark, "documents", LARGER)}
    got = QUERIES["op3_language_id"](spark, LARGER).collect()
    assert {x.doc_id for x in got} == set(lang)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 for x in got)
    unseen = [x.lang_pred == lang[x.doc_id] for x in got if x.held_out]
    assert sum(unseen) / len(unseen) > 0.97


def test_quality_of_unseen_documents(spark):
    good = {x.doc_id: x.quality for x in rows(spark, "labels", LARGER)}
    got = QUERIES["op4_quality"](spark, LARGER).collect()
    assert len(got) == len({x.doc_id for x in got}) == len(rows(spark, "documents", LARGER))
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    assert all(x.predicted == (x.score >= 0.7) and 0 <= x.score <= 1 for x in got)
    unseen = [x.predicted == good[x.doc_id] for x in got if x.held_out and x.doc_id in good]
    assert sum(unseen) / len(unseen) > 0.93


def test_secrets(spark):
    import re

    got = QUERIES["op9_secret_scan"](spark, LARGER).collect()
    planted = {(d.doc_id, m) for d in rows(spark, "documents", LARGER) for m in re.findall(r'AKIA[0-9A-Z]{16}|token = "([0-9a-f]{40})', d.text) if m}
    found = {(x.doc_id, x.candidate) for x in got if x.secret}
    assert planted and planted <= found


def test_pipeline_against_the_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    accepted = {x.doc_id for x in QUERIES["op4_quality"](spark, SF).collect() if x.predicted}
    text = {d.doc_id: d.text for d in docs.collect()}
    left = [(i, text[i]) for i in sorted(accepted)]
    left = [(i, text[i]) for i, _, _, stays, _ in plain.exact(left) if stays]
    left = [(i, text[i]) for i in sorted({c for _, _, c in plain.simhash(left)})]
    leaky = {i for i, _ in plain.leaks(left, [(b.item_id, b.text) for b in rows(spark, "benchmark")])}
    wanted = {i for i, _ in left} - leaky
    stage = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, stage, SF)
        assert stage.columns == docs.columns, name
    assert {x.doc_id for x in stage.collect()} == wanted and stage.count() == len(wanted) < len(text)
    final = corpus_pipeline.run(spark, SF)
    assert {x.doc_id for x in final.collect()} <= wanted
    from teleloom.llm import mixing

    again = mixing.mix_sources(stage)
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, again.collect()))


def test_pipeline_stages_over_awkward_rows(spark):
    found = [(1, None, 1), (2, "", 2), (3, " ", 3), (4, "word", 4), (4, "word", 4), (5, "long " * 30_000, 5)]
    docs = spark.createDataFrame([(*x, "s", 0.1) for x in found], "doc_id long, text string, copy int, source string, score double")
    for name, function in corpus_pipeline.STAGES:
        result = function(spark, docs, SF)
        assert {"doc_id", "text", "source", "score"} <= set(result.columns), name
        result.collect()
        assert function(spark, docs.limit(0), SF).count() == 0
