"""Registered queries that SQL cannot express, on the driver's small table, against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from conftest import DATA
from foliometry.llm import langid, license_scan, packing, pii, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_license_scan(spark):
    docs = documents(spark)
    for r in queries.QUERIES["op2_license_scan"](spark, DATA).collect():
        words = WORD.findall(lower(docs[r.doc_id].text))
        places = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        labels = sorted({label for _, label in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) | ({""} if not labels else set()) and 0 <= r.score <= 1


def test_language_by_dense_vectors(spark):
    docs, cache = documents(spark), {}

    def letter(c):
        if c not in cache:
            cache[c] = langid.letter_vectors(np.array([ord(c)], np.uint64), langid.DIMS)[0].astype(float)
        return cache[c]

    def bundle(text):
        symbols = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
        symbols = re.sub(" +", " ", symbols)
        if not symbols.strip():
            return None
        grams = Counter(symbols[i : i + 3] for i in range(len(symbols) - 2))
        return sum(n * np.roll(letter(g[0]), 2) * np.roll(letter(g[1]), 1) * letter(g[2]) for g, n in grams.items())

    vectors = {k: bundle(r.text) for k, r in docs.items()}
    prototypes = {}
    for k, r in docs.items():
        if zlib.crc32(str(k).encode()) % 3 != 1 and r.lang is not None and vectors[k] is not None:
            prototypes[r.lang] = prototypes.get(r.lang, 0) + vectors[k] / np.linalg.norm(vectors[k])
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    for r in queries.QUERIES["op8_language"](spark, DATA).collect():
        v = vectors[r.doc_id]
        if v is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            scores = {lang: cosine(v, p) for lang, p in prototypes.items()}
            assert abs(r.score - max(0.0, max(scores.values()))) < 1e-4 and scores[r.lang_pred] > max(scores.values()) - 1e-4


def test_personal_data_on_planted_texts():
    """Precision and recall on texts of other lines and values than the labelled ones."""
    field, rng = pii.train(), np.random.default_rng(9)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    truth = found = right = 0
    for k in range(400):
        secret = "".join(rng.choice(list("0123456789abcdef"), 40))
        plain = [f"we counted {digits(3)} birds in {1900 + k % 120}", f"see page {k} of volume {k % 9}", f"it cost {k}.{digits(2)} then"][k % 3]
        kind, value, text = [
            ("phone", f"({200 + k}) 555-{1000 + k}", "please ring {} after noon"), ("secret", secret, 'api_key = "{}"'), ("email", f"x{k}.y@host{k}.org", "reach me: {}"),
            ("ip", f"{k % 200 + 1}.{k % 90}.7.{k % 250}", "the machine {} answers"), ("phone", f"+44 20 7946 {1000 + k}", "our line is {} all day"),
        ][k % 5]
        whole = f"{plain}. " + text.format(value)
        base = pii.base_spans(whole)
        spans = base + pii.added_spans([whole], [base], field)[0]
        at = whole.index(value)
        truth += 1
        found += len(spans)
        right += any(pii.KINDS[s] == kind and a < at + len(value) and at < b for s, a, b in spans)
    assert right / truth > 0.95 and right / found > 0.9, (right, truth, found)


def test_pipeline_by_plain_python(spark):
    """All five stages again without Spark operators: lines, shingle sets over all pairs, alignments on every diagonal, whole tokens."""
    from tokenizers import Tokenizer

    kept = {r.doc_id: r for r in corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA).collect()}
    docs = documents(spark)
    assert all(not re.search(r"[^\W\d_]", docs[k].text or "") for k in set(docs) - set(kept))
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    owner = {}
    for k in sorted(kept):
        for x in (kept[k].text or "").split("\n"):
            owner.setdefault(key(x), k)
    texts = {k: "\n".join(x for x in (r.text or "").split("\n") if len(key(x)) < 10 or owner[key(x)] == k) for k, r in kept.items()}
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    where = {}
    for k in sorted(sets):
        met = Counter(o for s in sets[k] for o in where.get(s, ()))
        for o, both in met.items():
            if 100 * both >= 80 * (len(sets[k]) + len(sets[o]) - both):
                a, b = find(k), find(o)
                root[max(a, b)] = min(a, b)
        for s in sets[k]:
            where.setdefault(s, []).append(k)
    texts = {k: t for k, t in texts.items() if find(k) == k}
    items = [WORD.findall(lower(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    by_word = {}
    for n, item in enumerate(items):
        for q in range(len(item) - 1):
            by_word.setdefault((item[q], item[q + 1]), []).append((n, q))

    def leaks(text):
        words = WORD.findall(lower(text))
        for n, shift in {(n, p - q) for p in range(len(words) - 1) for n, q in by_word.get((words[p], words[p + 1]), ())}:
            item, score, start, best = items[n], 0, 0, (0, 0, 0)
            for q in range(max(0, -shift), min(len(item), len(words) - shift)):
                if score <= 0:
                    score, start = 0, q
                score += 1 if item[q] == words[q + shift] else -2
                best = max(best, (score, -start, q + 1), key=lambda b: b[0])
            lo, hi = -best[1], best[2]
            same = sum(item[q] == words[q + shift] for q in range(lo, hi))
            if same >= min(10, len(item)) and len(item) >= 6 and 100 * same >= 80 * (hi - lo):
                return True
        return False

    texts = {k: t for k, t in texts.items() if not leaks(t)}
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = {k: len(tok.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts.items()}
    got = Counter()
    for r in corpus_pipeline.run(spark, DATA).collect():
        got[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert dict(got) == want
