"""Nulls in any column, repeated and shared ids, long texts, ties, clashing names, 32-bit ids: through all operators and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliometry.llm import decontaminate, embedding_dedup, langid, license_scan, line_dedup, lm, minhash, packing, pii, quality

PASSAGE = " ".join(f"p{'abcdefghij'[i % 10]}{i}" for i in range(40))
HUGE = " ".join(f"word{i % 9973}" for i in range(600_000))  # about 5 MB
ROWS = [
    (None, "a text without an id that has a few words", "en", None, None), (None, None, None, None, None), (1, "The same text in two rows, with the same id.", "en", "s", 1), (1, "The same text in two rows, with the same id.", "en", "s", 1),
    (1, "first line that is said again\nother words of a shared id", "en", "s", 2), (2, "The same text in two rows, with the same id.", None, "s", 3), (3, "first line that is said again\nand one more line to stay", "de", "s", 4),
    (4, "", "fr", "", 0), (4, None, "fr", None, None), (5, HUGE, "en", "s", 5), (6, f"und hier {PASSAGE} steht es", "de", "s", 6), (7, "!!! 12 ###", "en", "s", 7), (8, "a", "en", "s", 8), (None, "first line that is said again", "en", "s", 9),
]
SCHEMA = "doc_id {}, text string, lang string, source string, n_chars long"
BENCH = [(1, PASSAGE), (None, PASSAGE), (2, None), (3, ""), (1, PASSAGE)]


@pytest.fixture(scope="module", params=["long", "int"])
def docs(spark, request):
    df = spark.createDataFrame(ROWS, SCHEMA.format(request.param))
    for c in ("d", "key", "rep", "node", "label", "__row", "__d", "n_lines", "t", "iw", "words", "__key0", "__key1"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def by_row(rows, *cols):
    return Counter(tuple(r[c] for c in cols) for r in rows)


def held(i, n, k):
    return i is not None and zlib.crc32(str(i).encode()) % n == k


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_decontamination(docs, bench):
    assert {(r.doc_id, r.item_id, r.n_matched) for r in decontaminate.leaks(docs, bench).collect()} == {(6, 1, 40), (6, None, 40)}
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.count() == len(ROWS) - 1 and left.columns == docs.columns


def test_license_scan(docs):
    got = license_scan.query(docs).collect()
    assert by_row(got, "doc_id", "n_words") == Counter((i, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)))) for i, t, *_ in ROWS)


def test_minhash(docs):
    got = minhash.near_duplicates(docs, width=4).collect()
    assert len(got) == len(ROWS)
    assert by_row(got, "doc_id", "component_id", "kept")[1, 1, True] == 3 and by_row(got, "doc_id", "component_id", "kept")[2, 1, False] == 1
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    left = minhash.drop_near_duplicates(docs).collect()
    # of the two equal rows of id 1 one stays, its other text stays, id 2 goes; of the two empty rows of id 4 one stays
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [1, 1, 3, 4, 5, 6, 7, 8] and sum(r.doc_id is None for r in left) == 3
    assert {r.text for r in left if r.doc_id == 1} == {ROWS[2][1], ROWS[4][1]}


def test_line_dedup(docs):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_n_lines", "n_dropped"]
    strip = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, t, *_ in ROWS:
        for x in (t or "").split("\n") if i is not None else ():
            if len(strip(x)) >= 10:
                first.setdefault(strip(x), set()).add(i)
    want = Counter()
    for i, t, *_ in ROWS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(first.get(strip(x), ())) < 2 or min(first[strip(x)]) == i]
        want[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    assert by_row(line_dedup.query(docs).collect(), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, None), (3, 1, 0), (3, 0, 0), (None, 1, 1), (5, None, None), (99, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.query(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1


def test_personal_data(docs):
    assert by_row(pii.query(docs).collect(), "doc_id", "n_email") == Counter((i, 0) for i, *_ in ROWS)


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter((i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in ROWS)
    got = packing.pack_documents(docs, packing.default_tokenizer()).collect()
    assert by_row([r for r in got if r.start == 0], "doc_id", "doc_tokens") == want
    assert sum(r.length for r in got) == sum(n * k for (_, n), k in want.items())


def test_language(docs):
    got = langid.query(docs).collect()
    assert len(got) == len(ROWS) and {r.lang_pred for r in got if r.doc_id in (4, 7)} == {"und"}
    left = langid.keep_known(docs)
    assert left.columns == docs.columns and left.schema == docs.schema
    assert all(any(map(str.isalpha, r.text)) for r in left.collect())


def test_language_model(docs):
    got = lm.query(docs).collect()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    counts = Counter(w for i, t, *_ in ROWS if i is not None and not held(i, 7, 2) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, *_ in ROWS:
        want[i, len(tokens(t)), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)] += 1
    assert Counter((r.doc_id, r.n_tokens, round(r.base_score, 4)) for r in got) == want and all(math.isfinite(r.score) for r in got)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 8)).round(3)
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(None, [1.0] * 8), (0, [float(v) for v in x[0]]), (0, [float(v) for v in x[1]]), (41, [float(v) for v in x[2]]), (42, None), (43, []), (44, [0.0] * 8), (45, [1.0, None] * 4), (46, [math.inf] + [1.0] * 7), (47, [1.0, 2.0]), (48, [2.0, 4.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, f"vec_id int, embedding array<{kind}>").withColumn("v", F.lit(1)).withColumn("dims", F.lit(1))).collect()
    assert len(got) == len(rows)
    one = {r.vec_id: r for r in got}
    assert one[41].component_id == 2 and one[41].n_links == 1 and not one[41].kept and one[48].component_id == 47
    assert one[1].component_id == 0 and all(one[k].n_links == 0 and one[k].kept for k in (None, 42, 43, 44, 45, 46))


def test_pipeline(spark, docs, bench, tmp_path):
    out = docs
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns
    left = out.collect()
    # the empty texts and the one without letters go, one of the equal rows of id 1 goes, id 6 holds the passage; id 2 lost its only line
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [1, 1, 2, 3, 5, 8] and sum(r.doc_id is None for r in left) == 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == {None, 1, 2, 3, 5, 8}
