"""Arriving files are scored once; a second run scores new files only."""

import tempfile

from pyspark.sql import functions as F

from foliometry.streaming.incremental import score_arrivals


def test_scores_new_files_only(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    schema = "paper long, page long, dim string, role string, value double"
    block = spark.createDataFrame([("d", "A", 2.0, 1.0, 3.0)], "dim string, role string, scale double, lo double, hi double")
    rows = lambda k: spark.createDataFrame([(k, 1, "d", "A", 5.0), (k, 1, "d", "A", 5.0), (k, 2, "d", "A", 2.0)], schema)
    for k in (1, 2):
        rows(k).write.mode("append").parquet(f"{folder}/in")
        score_arrivals(spark, f"{folder}/in", rows(1).schema, block, f"{folder}/out", f"{folder}/state").awaitTermination()
    got = sorted((r.paper, r.page, r.loss) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [(1, 1, 1.0), (1, 2, 0.0), (2, 1, 1.0), (2, 2, 0.0)]
    assert spark.read.parquet(f"{folder}/out").select(F.col("batch")).distinct().count() == 2


def test_page_documents_and_damaged_files(spark):
    import json
    import os

    folder = tempfile.mkdtemp(prefix="spark-")
    for k in range(3):
        with open(os.path.join(folder, f"p{k}.json"), "w") as f:
            f.write(json.dumps({"paper": k, "pages": [{"page": 1, "v": 0.5}, {"page": 2, "v": None}]}, indent=1) if k < 2 else '{"paper": 2, "pages": [')
    schema = spark.createDataFrame([], "paper long, pages array<struct<page:long,v:double>>").schema
    from foliometry.sources import scans

    rows, bad = scans.page_docs(spark, folder, schema)
    assert sorted((r.paper, r.page.page, r.page.v) for r in rows.collect()) == [(k, p, v) for k in (0, 1) for p, v in ((1, 0.5), (2, None))]
    assert [r.file for r in bad.collect()] == ["p2.json"]
