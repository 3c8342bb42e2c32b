"""Lexical search in shards against plain scoring of all documents; what is decompressed; odd rows."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliometry.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items, k):
    """(item place, rank, doc_id, score) by scoring every document."""
    counts = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := terms(t))]
    n, total = len(counts), sum(c[2] for c in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for q, (item, text) in enumerate(items):
        scored = []
        for i, c, size in counts:
            m = 100 - 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def corpus(n, seed):
    """Words of Zipf-like frequency, lengths of 0 to 400, and many ties from repeated texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    weights = [1 / (k + 1) for k in range(500)]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([0, 3, 20, 400]))) for _ in range(n)]
    return [(k, rng.choice(texts[:40]) if k % 5 == 0 else t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("most_postings", "k"), [(1 << 20, 50), (3000, 7), (500, 3)])
def test_search_equals_plain_scoring(spark, most_postings, k):
    docs, rng = corpus(1500, k), random.Random(1)
    items = [(q, " ".join(f"W{min(int(rng.paretovariate(0.4)), 520)}" for _ in range(rng.randint(1, 30)))) for q in range(40)]
    shards = ls.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), most_postings=most_postings)
    assert (shards.count() > 10) == (most_postings < 10_000)
    got = ls.search(shards, spark.createDataFrame(items, "item_id long, text string"), k)
    assert Counter(tuple(r) for r in got.collect()) == plain(docs, items, k)


def test_shards_added_later_count(spark):
    docs = corpus(400, 9)
    halves = [ls.build(spark.createDataFrame(docs[a:b], "doc_id long, text string")) for a, b in ((0, 150), (150, 400))]
    items = [(1, "w0 w3 w77"), (2, "w1")]
    got = ls.search(halves[0].union(halves[1]), spark.createDataFrame(items, "item_id long, text string"), 20)
    assert Counter(tuple(r) for r in got.collect()) == plain(docs, items, 20)


def test_blocks_that_cannot_count_stay_compressed():
    builder = ls.Builder()
    texts = ["rare common common"] * 60 + ["common " + " ".join(f"filler{k}" for k in range(30))] * 6000
    builder.add(list(range(len(texts))), texts)
    row = builder.row()
    columns = {f.name: pa.array([row[f.name]], f.type)[0] for f in ls._schema()}
    row = {c: x.as_py() if c in ("doc_ids", "postings", "n_docs", "n_terms") else x.values if c == "terms" else x.values.to_numpy() for c, x in columns.items()}
    shard = ls.Shard(row, pa.array(["common", "rare"]), row["n_docs"], row["n_terms"])
    found, scores = shard.best([(0, 5), (1, 5000)], 1, 50)
    assert len(found) >= 50 and set(found) <= set(range(6060))
    whole = sum(int(b) for b in shard.last.shape)
    fresh = ls.Shard(row, pa.array(["common", "rare"]), row["n_docs"], row["n_terms"])
    again, _ = fresh.best([(0, 5), (1, 5000)], int(scores.max()), 50)
    assert len(again) == 60 and len(fresh.decoded) < whole / 20  # the common list is asked for one block of 48


def test_odd_rows(spark):
    docs = [(None, "alpha beta"), (None, None), (3, ""), (4, "!!!"), (5, "Alpha"), (5, "alpha"), (5, "ALPHA beta gamma"), (6, "naïve ÉCOLE 漢字"), (7, "word " * 300_000 + "alpha"), (8, "alpha beta")] + [(20 + k, "other text") for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    for c in ("terms", "query", "part", "score", "rank", "item_id"):
        df = df.withColumn(c, F.lit("x"))
    items = [(1, "alpha BETA"), (1, "alpha BETA"), (None, "alpha"), (2, None), (3, "?"), (4, "unknown"), (5, "École école É naïve")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1)).withColumn("term", F.lit(1))
    assert Counter(tuple(r) for r in ls.query(df, frame).collect()) == plain(docs, items, 50)
    assert ls.query(df.limit(0), frame).collect() == [] and ls.query(df, frame.limit(0)).collect() == []
