"""The registered queries on the driver's tables: SQL where it can express them, held-out quality and brute force elsewhere."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from conftest import DATA
from foliometry.llm import decontaminate, minhash, queries
from helpers import same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, DATA), duck, queries.SQL[name])


def held(doc_id, n, k):
    return zlib.crc32(str(doc_id).encode()) % n == k


def test_language_is_right_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_language"](spark, DATA).collect()
    assert len(rows) == len(truth) and all(r.held_out == held(r.doc_id, 3, 1) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.95


def test_quality_ranks_held_out_documents(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op5_quality"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in truth]
    good, bad = ([r.score for r in rows if truth[r.doc_id] == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97 and np.mean([s >= 0.3 for s in good]) > 0.97


def test_language_model_beats_unigrams_on_held_out_documents(spark):
    rows = [r for r in queries.QUERIES["op9_lm_score"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = out
        out = stage(spark, before, DATA)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "language_id":  # later, a document may lose all its lines and stay with an empty text
            assert all(re.search(r"[^\W\d_]", r.text) for r in out.collect())
    rest = out.collect()
    assert minhash.near_duplicates(out).where("not kept").count() == 0
    assert decontaminate.leaks(out, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    pieces = corpus_pipeline.run(spark, DATA).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in rest}
