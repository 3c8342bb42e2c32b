"""Byte-level BPE against the tiktoken library, alignment of two tokenizers against plain Python; odd rows of both."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from foliometry.llm import alignment, byte_bpe, gather, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCRAPS = "the of and straße été 漢字 emoji 😀 <s> </s> <|endoftext|> <0x41> aaaa  \n \t x1234 don't we'll ﬁ é \x00 ciónrr ñezll -- __ ５６   　 \r\n".split(" ") + [" ", "  ", "▁"]


def scraps(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SCRAPS) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


ODD = [(None, "no id"), (None, None), (1, "same row"), (1, "same row"), (1, "other text of a shared id"), (2, None), (3, ""), (4, " "), (5, "\n\n\t"), (6, "word " * 400_000), (7, "x" * 300_000), (8, "▁ in a text"), (9, "<|endoftext|> <s>")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id int, text string")
    for c in ("ids", "row", "links", "pair", "docs", "best", "decoded"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_model_equals_the_library_on_scraps(library, monkeypatch):
    texts = [*scraps(2000, 3), "".join(random.Random(4).choice("abc") for _ in range(50_000))]
    for stretch in (500_000, 7):
        monkeypatch.setattr(gather, "STRETCH", stretch)
        ids, bounds = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)(texts)
        raw, ends = byte_bpe.Decoder(RANKS)(ids, bounds)
        for k, t in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode_ordinary(t)
            assert raw[ends[k] : ends[k + 1]].tobytes() == t.encode()


def test_model_equals_the_library_on_letters_of_all_kinds(library):
    texts = [f"a{c}b {c}1{c} {c}" for k in range(0, 0x30000, 7) if not 0xD800 <= k < 0xE000 for c in [chr(k)]]
    ids, bounds = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)(texts)
    assert [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]


def test_store_of_words_stays_small(library, monkeypatch):
    monkeypatch.setattr(gather, "MOST_WORDS", 50)
    monkeypatch.setattr(gather, "MOST_CHARS", 400)
    encoder = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for t in scraps(300, 5):
        assert encoder([t])[0].tolist() == library.encode_ordinary(t)
        assert len(encoder.by_word.place) <= 50 + len(SCRAPS)


def test_ids_outside_the_vocabulary_are_an_error(spark):
    encoded = spark.createDataFrame([(1, [5, 60_000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode(encoded, RANKS).collect()


def test_decoding_cuts_batches_and_takes_nulls(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST_IDS", 10)
    rows = [(k, None if k % 7 == 0 else list(range(k % 23))) for k in range(200)]
    plain = byte_bpe.Decoder(RANKS)
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "ids": x} for i, x in rows])
    got = [x for part in byte_bpe._decoding(RANKS)(iter([batch.slice(3)])) for x in part.column("decoded").to_pylist()]
    assert got == [plain(np.array(x or [], np.int32), np.array([0, len(x or [])]))[0].tobytes() for _, x in rows[3:]]


def expected_bytes(rows, library):
    out = Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        out[i, len(ids), sha(",".join(map(str, ids))), sha((t or "").encode())] += 1
    return out


def test_byte_bpe_query(spark, library, odd, none):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(tuple(r) for r in queries.QUERIES["op13_byte_bpe"](spark, DATA).collect()) == expected_bytes(rows, library)
    assert Counter(tuple(r) for r in byte_bpe.query(odd).collect()) == expected_bytes(ODD, library)
    assert byte_bpe.query(none).collect() == []


class Plain:
    """Alignment of one text by walking over token ends."""

    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.names = {i: t for t, i in self.a.get_vocab().items()}
        self.byte = alignment.byte_letters()

    def raw_b(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(self, t):
        """[(ids of A, ids of B)], or None; and (A place, B place, shared bytes) of overlapping tokens."""
        if not t:
            return None, []
        a, b = self.a.encode(" " + t, add_special_tokens=False).ids, self.b.encode(t)
        raw_a, raw_b = [bytes(self.byte[c] for c in self.names[i]) for i in a], [self.raw_b(i) for i in b]
        if b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            return None, []
        spans = []
        for raw in (raw_a, raw_b):
            ends = list(accumulate(map(len, raw)))
            spans.append(list(zip([0, *ends], ends, strict=False)))
        out, i, j = [], 0, 0
        for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            k, m = i, j
            while i < len(a) and spans[0][i][1] <= cut:
                i += 1
            while j < len(b) and spans[1][j][1] <= cut:
                j += 1
            out.append((a[k:i], b[m:j]))
        over = [(x, y, min(p[1], q[1]) - max(p[0], q[0])) for x, p in enumerate(spans[0]) for y, q in enumerate(spans[1]) if p[0] < q[1] and q[0] < p[1]] if len(a) < 200 else []
        return out, over


def expected_links(rows):
    plain = Plain()
    found = [(i, plain.groups(t)[0]) for i, t in rows]
    links = [Counter((x, y) for a, b in g or () for x in a for y in b) for _, g in found]
    docs = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = Counter()
    for (i, g), c in zip(found, links, strict=True):
        text = "" if g is None else sha(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g))
        numbers = (sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), sum(c.values()))
        out[i, *numbers, sum(n for p, n in c.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in c.items()), text] += 1
    return out


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_alignment_query(spark, odd, none, monkeypatch, most):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)  # beyond it, pairs are joined by shuffle
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(tuple(r) for r in queries.QUERIES["op12_alignment"](spark, DATA).collect()) == expected_links(rows)
    assert Counter(tuple(r) for r in alignment.query(odd).collect()) == expected_links(ODD)
    assert alignment.query(none).collect() == []


def test_alignment_of_scraps(monkeypatch):
    plain, texts = Plain(), scraps(400, 6)
    aligner = alignment.Aligner(A, B)
    for most in (1 << 21, 50):
        monkeypatch.setattr(alignment, "MOST_PRODUCTS", most)
        got = aligner(texts)
        for k, (t, held) in enumerate(zip(texts, got["links"].to_pylist(), strict=True)):
            g = plain.groups(t)[0]
            want = Counter((x, y) for a, b in g or () for x in a for y in b)
            assert {(e["pair"] >> 32, e["pair"] & (1 << 32) - 1): e["times"] for e in held} == want
            assert got["n_groups"][k] == len(g or ())
    assert sum(plain.groups(t)[0] is None for t in texts) < len(texts)


def test_overlap_links(spark):
    plain, texts = Plain(), scraps(60, 7)
    got = Counter((r.doc_id, r.a_at, r.b_at, r.n_bytes) for r in alignment.overlap_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B).collect())
    assert got == Counter((k, *x) for k, t in enumerate(texts) for x in plain.groups(t)[1])
