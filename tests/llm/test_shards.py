"""A table of shards is written in row groups of some shards."""

import glob

import pyarrow.parquet as pq

from foliometry.llm import lexical_search


def test_few_shards_a_row_group(spark):
    """All shards of a task were one group, which a reader holds as a whole."""
    docs = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2} w{i + 3}") for i in range(6000)], "doc_id long, text string").coalesce(1)
    shards = lexical_search.build(docs, most_postings=200)
    (path,) = glob.glob(f"{shards._foliometry_path}/*.parquet")
    meta = pq.ParquetFile(path).metadata
    assert meta.num_rows >= 20 and max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= 4
    items = spark.createDataFrame([(1, "w17 w18")], "item_id long, text string")
    assert [r.doc_id for r in lexical_search.search(shards, items, 1).collect()] == [15]
