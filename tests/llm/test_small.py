"""Operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliometry.llm import decontaminate, embedding_dedup, langid, license_scan, line_dedup, lm, minhash, packing, pii, quality

WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS[(i * 7 + i // 13) % 400] for i in range(3000))
PASSAGE = " ".join(f"p{i}" for i in range(30))
TEXTS = {
    0: None, 1: "", 2: " \n\t ", 3: "one", 4: "one two three", 5: LONG, 6: LONG, 7: LONG.replace("w5 ", "x5 ", 2), 8: "Alpha beta GAMMA delta epsilon zeta\nA line that is repeated here\nend",
    9: "other first\n  a LINE that is repeated HERE \nend", 10: f"start of it {PASSAGE} and its end", 11: "Mail a.b@c.org, call +1 (234) 555-1234 or 4111111111111111 at 10.0.0.1", 12: "ünï cödé ßtraße été 漢字 emoji 😀 text",
    13: "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nunder the MIT License and the mit license", 14: "!!! ### $$$ 123", 15: "one two three",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k == 3 else "en", f"s{k % 3}", len(t or "")) for k, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def clashing(df):
    for c in ("d", "key", "component_id", "kept", "words", "h1", "a", "b", "score", "line", "pos", "rep", "block", "item_id"):
        df = df.withColumn(c, F.lit("x"))
    return df


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))


def brute_components(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_minhash_matches_brute_force(docs):
    sets = {}
    for k, t in TEXTS.items():
        w = tokens(t)
        sets[k] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(links, sets)
    got = {r.doc_id: r for r in minhash.query(docs).collect()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(got[k].n_shingles == len(sets[k]) and got[k].kept == (want[k] == k) for k in sets)


def _changed(words, places, tag):
    return [f"{tag}{k}" if k in places else w for k, w in enumerate(words)]


@pytest.mark.parametrize(("chains", "length"), [(2000, 3), (300, 6)])
def test_minhash_loses_no_link_of_chains(spark, chains, length):
    """Neighbours in a chain are similar (0.84), others are not (0.71 at most): each chain is one component, found through its links alone."""
    rng = np.random.default_rng(chains)
    rows, want = [], {}
    for chain in range(chains):
        base = [f"c{chain}w{k}" for k in range(120)]
        places = rng.permutation(np.arange(6, 114, 9))[: 2 * length]
        ids = (chain * length + rng.permutation(length)).tolist()  # the smallest id stands anywhere in the chain
        texts = [base]
        for k in range(length - 1):  # each text has two words of its own beside what it took over
            texts.append(_changed(texts[-1], set(places[2 * k : 2 * k + 2].tolist()), f"x{chain}n{k}w"))
        rows += [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)]
        want |= dict.fromkeys(ids, min(ids))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.component_id != want[r.doc_id] for r in got) == 0 and len(got) == len(rows)


def test_minhash_large_group_of_near_misses(spark):
    """A bucket whose centre links few of its members: links among the others are found, in blocks."""
    base = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(40):
        w = list(base)
        for j in range(9):
            w[(k // 2 * 7 + j * 6) % 60] = f"v{k // 2}_{j}"
        w[0] = f"z{k}" if k % 2 else w[0]
        rows.append((k, " ".join(w)))
    sets = {k: {tuple(t.split()[i : i + 4]) for i in range(57)} for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(links, sets)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == want


def test_line_dedup_matches_brute_force(docs):
    keys = {}
    strip = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    for k, t in TEXTS.items():
        for x in (t or "").split("\n"):
            if len(strip(x)) >= 10:
                keys.setdefault(strip(x), set()).add(k)
    for r in line_dedup.query(docs).collect():
        lines = (TEXTS[r.doc_id] or "").split("\n")
        kept = [x for x in lines if not (len(keys.get(strip(x), ())) >= 2 and r.doc_id != min(keys[strip(x)]))]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()), r.doc_id


def test_line_dedup_keeps_other_columns(docs):
    out = line_dedup.dedup_lines(clashing(docs))
    assert set(clashing(docs).columns) <= set(out.columns) and out.count() == len(TEXTS)
    named = line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit(-1)).withColumn("__dropped", F.lit(-2)))
    assert named.columns[-2:] == ["_n_lines", "n_dropped"] and named.where("n_lines = -1 and __dropped = -2 and _n_lines > 0").count() == len(TEXTS)


def test_leaks_tolerate_substitutions(spark, docs):
    w = PASSAGE.split()
    w[12], w[20] = "other", "words"
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "too short"), (4, " ".join(w)), (5, " ".join(f"q{i}" for i in range(30)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(clashing(docs), bench).collect()}
    assert set(got) == {(10, 1), (10, 4)}
    assert (got[10, 1].n_matched, got[10, 1].n_aligned, got[10, 1].doc_start, got[10, 1].item_start) == (30, 30, 3, 0)
    assert (got[10, 4].n_matched, got[10, 4].n_aligned) == (28, 30)


def test_leaks_by_shuffle(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, PASSAGE), (2, LONG[:400])], "item_id long, text string")
    whole = decontaminate.leaks(docs, bench).collect()
    monkeypatch.setattr(decontaminate, "MOST_SEEDS", 7)
    monkeypatch.setattr(decontaminate, "MOST_WORDS", 7)
    assert len(whole) > 1 and sorted(decontaminate.leaks(docs, bench).collect()) == sorted(whole)


def test_short_items_count_where_they_stand_whole(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "seven words are a short item too"), (3, "five words are too few")], "item_id long, text string")
    texts = spark.createDataFrame([(1, "x One two, three four five six seven eight nine y"), (2, "one two three four five six seven eight ten"), (3, "five words are too few"), (None, "seven words are a short item too")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_matched) for r in decontaminate.leaks(texts, bench).collect()} == {(1, 1, 9), (None, 2, 7)}


def test_license_scan(docs):
    got = {r.doc_id: r for r in license_scan.scan(clashing(docs)).collect()}
    assert got[0].n_words == 0 and got[0].labels == [] and got[0].score == 0 and got[0].first_word is None
    r = got[13]
    assert r.labels == ["apache", "gpl", "mit"] and r.base_labels == ["mit"] and r.n_base == 2 and r.usable is True


@pytest.mark.parametrize(("text", "value"), [("MIT", True), ("GPL-3.0-only OR MIT", True), ("GPL-3.0-only AND MIT", False), ("MIT WITH x-exception AND ISC", True), ("(GPL-2.0 OR (MIT AND ISC)) AND BSD-3-Clause", True)])
def test_license_expressions(text, value):
    assert license_scan.evaluate(license_scan.to_postfix(text))[0] is value


@pytest.mark.parametrize("text", ["", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT ISC", "()"])
def test_malformed_expressions(text):
    with pytest.raises(license_scan.Malformed):
        license_scan.to_postfix(text)


def test_license_base_places():
    text = "The GNU General, Public License; mit license mit license cc-by"
    r = license_scan.scan_text(text)
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (4, 1, 9, ["cc-by", "gpl", "mit"])


def test_pii_base_and_added():
    field = pii.train()
    text = "pay 4111111111111111 4012888888881881 now, key token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" a@b.co +1 (234) 555-1234"
    base = pii.base_spans(text)
    added = pii.added_spans([text], [base], field)[0]
    kinds = Counter(pii.KINDS[k] for k, _, _ in base + added)
    assert kinds == {"email": 1, "phone": 1, "card": 2, "secret": 1}
    assert all(not (a < f and e < b) for _, a, b in base for _, e, f in added)


def test_pii_leaves_clean_text_alone():
    field = pii.train()
    texts = ["In 2024 there were 12 of 345 cases on page 7.", "no digits here", "", "version 1.2.3 of 10-12"]
    assert pii.added_spans(texts, [pii.base_spans(t) for t in texts], field) == [[], [], [], []]


def test_pii_query(docs):
    got = {r.doc_id: r for r in pii.query(clashing(docs)).collect()}
    assert (got[11].n_email, got[11].n_ip, got[11].n_card, got[11].n_phone) == (1, 1, 1, 1) and got[0].spans == ""


def test_viterbi_finds_the_best_path():
    field = pii.train()
    chains = [[w[2] for w in r] for t in pii.labelled()[:40] for r in pii.runs(re.sub(r"\[\w+:([^\]]*)\]", r"\1", t))]
    for chain, path in zip(chains, field.decode(chains), strict=True):
        if len(chain) <= 3:
            e = field.emissions([chain], len(chain))[0]
            m, n = field.moves, len(pii.LABELS)
            score = lambda p: m[0, p[0]] + sum(e[t, p[t]] for t in range(len(p))) + sum(m[a, b] for a, b in zip(p, p[1:], strict=False)) + m[p[-1], 0]
            best = max(score(p) for p in np.ndindex(*[n] * len(chain)))
            assert abs(score(tuple(path)) - best) < 1e-6


def test_packing_is_exact_and_tight(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for k, t in TEXTS.items()}
    rows = packing.pack_documents(clashing(docs), packing.default_tokenizer(), most_tokens=512).collect()
    for k, want in ids.items():
        pieces = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        at = 0
        for r in pieces:
            assert r.start == at and r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512 and at & (at - 1) == 0


def test_packing_ids_equal_the_tokenizer_on_any_letter():
    from tokenizers import Tokenizer

    tok, encode = Tokenizer.from_file(packing.default_tokenizer()), packing.Encoder(packing.default_tokenizer(), 2)
    letters = [chr(i) for i in range(0x110000) if chr(i).isalpha()]
    texts = []
    for i in range(0, len(letters), 100):
        texts += [" ".join(form(c) for c in letters[i : i + 100]) for form in (lambda c: c, lambda c: f"a{c}b", lambda c: f"{c}.", lambda c: f"x{c}, {c}!")]
    rng, odd = np.random.default_rng(6), [*map(chr, [*range(0x250), *range(0x300, 0x370), *range(0x900, 0x980), *range(0xFB00, 0xFB50), *range(0x1100, 0x1200), 0x130, 0x200D, 0x3000, 0x1F600]), "<|endoftext|>", "<|", " ", "\n", "."]
    texts += ["".join(odd[k] for k in rng.integers(len(odd), size=rng.integers(40))) for _ in range(3000)]
    for i in range(0, len(texts), 200):
        for text, ids in zip(texts[i : i + 200], encode(texts[i : i + 200]), strict=True):
            assert ids.tolist() == [*tok.encode(text, add_special_tokens=False).ids, 2], text


def test_packing_limits_of_instruction_data(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(n), int(n * q)) for k, (n, q) in enumerate(zip(rng.integers(5, 300, 400), rng.random(400), strict=True))]
    got = packing.pack_examples(spark.createDataFrame(rows, "example_id long, n_tokens long, n_loss long"), 1024, 8, 500).collect()
    assert sorted(r.example_id for r in got) == list(range(400))
    loss = {k: x for k, _, x in rows}
    for s in {r.sequence_id for r in got}:
        own = [r for r in got if r.sequence_id == s]
        assert sum(r.n_tokens for r in own) <= 1024 and len(own) <= 8 and sum(loss[r.example_id] for r in own) <= 500


def test_packing_tells_of_examples_that_fit_nowhere():
    with pytest.raises(ValueError):
        packing.Packer(10, 2, 10, cut=False).add(1, 11, 0)


def test_language_id(spark, docs):
    got = {r.doc_id: r for r in langid.query(clashing(docs)).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[14].lang_pred == "und" and got[0].score == 0
    assert got[5].lang_pred == "en" and 0 < got[5].score <= 1


def test_language_vectors_bind_and_bundle():
    b = langid.Bundler(512)
    v = b("abc")
    x = [langid.letter_vectors(np.array([c], np.uint64), 512)[0] for c in map(ord, " abc ")]
    want = sum(np.roll(x[i], 2) * np.roll(x[i + 1], 1) * x[i + 2] for i in range(3))
    assert (v == want).all() and b("1 2 3") is None


def test_language_training_without_labels(spark, none):
    assert langid.train(none, F.lit(True)) == {}
    assert langid.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), {}).first().lang_pred == "und"


def test_lm_base_matches_brute_force(docs):
    got = {r.doc_id: r for r in lm.query(clashing(docs)).collect()}
    seqs = {k: [*tokens(t), None] for k, t in TEXTS.items()}
    counts = Counter(w for k, ws in seqs.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for k, ws in seqs.items():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), n, zlib.crc32(str(k).encode()) % 7 == 2)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0


def test_lm_blocks_do_not_change_the_base(docs):
    one = {r.doc_id: r.base_score for r in lm.score(docs, F.lit(True)).collect()}
    many = {r.doc_id: r.base_score for r in lm.score(docs, F.lit(True), block_bytes=100).collect()}
    assert all(abs(one[k] - many[k]) < 1e-9 for k in one)


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    for k in range(60):
        x[100 + k] = x[k] + rng.standard_normal(16) * 0.12
    x[200:230] = x[5] + rng.standard_normal((30, 16)) * 0.05
    x[230], x[231] = x[7], 2 * x[7]
    rows = [(k, [float(v) for v in r], 0) for k, r in enumerate(x)] + [(300, None, 0), (301, [0.0] * 16, 0), (302, [math.nan] * 16, 0), (303, [1.0, None], 0), (304, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    want = brute_components([(int(a), int(b)) for a, b in np.argwhere(np.triu(link))], range(305))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(clashing(df), leaf=40, block=32).collect()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(got[k].n_links == (int(link[k].sum()) if k < 300 else 0) for k in got)


def test_quality_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(4)
    good = ["".join(rng.choice(list("abcdefgh ,."), 300)) for _ in range(300)]
    bad = ["".join(rng.choice(list("AB#$|! "), 300)) for _ in range(80)]
    x, y = np.array([quality.features(t) for t in good], float), np.array([quality.features(t) for t in bad], float)
    model = quality.fit(x[:150], np.concatenate([x[150:250], y[:50]]), 0.66)
    assert (model.score(x[250:]) >= 0.3).mean() > 0.95 and (model.score(y[50:]) < 0.3).mean() > 0.9


@pytest.mark.parametrize("text", [None, "", "\n", "x", "漢字", "a" * 200_000])
def test_quality_features_of_any_text(text):
    assert np.isfinite(quality.features(text)).all()


def test_quality_without_positives(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.query(docs, labels).collect()} == {0.5}


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        decontaminate.query(none, bench), license_scan.query(none), minhash.query(none), line_dedup.query(none), quality.query(none, labels), pii.query(none), packing.query(none), langid.query(none), lm.query(none), embedding_dedup.query(vectors),
    ):
        assert df.count() == 0


def test_lm_model_matches_brute_force(spark, docs):
    """Class counts, weights and scores by dictionaries; probabilities of all words and one unknown a class add up to 1."""
    from foliometry.llm.common import word_hashes
    import pyarrow as pa

    got = {r.doc_id: r.score for r in lm.query(docs).collect()}
    code = lambda w: lm.END if w is None else word_hashes(pa.array([w]))[0][0]
    seqs = {k: [int(code(w)) for w in [*tokens(t), None]] for k, t in TEXTS.items()}
    kind = lambda h: h >> (64 - lm.CLASS_BITS)
    learned = [k for k in seqs if zlib.crc32(str(k).encode()) % 7 != 2]
    counts = Counter(h for k in learned for h in seqs[k])
    by_class, mass = Counter(), Counter()
    for h, c in counts.items():
        by_class[kind(h)] += c
        mass[kind(h)] += c + 1
    total = sum(by_class.values()) + 0.5 * lm.CLASSES
    share = [(by_class[c] + 0.5) / total for c in range(lm.CLASSES)]
    rows, seen = lm.model_rows(len(counts)), Counter()
    contexts = lambda s: zip([int(lm.START), *s[:-1]], [int(lm.START), int(lm.START), *s[:-2]], s, strict=False)
    for k in learned:
        for one, two, h in contexts(seqs[k]):
            seen[0, one % rows, kind(h)] += 1
            seen[1, two % rows, kind(h)] += 1
    times = Counter()
    for (f, r, _), n in seen.items():
        times[f, r] += n
    weight = lambda f, r, c: 0.5 * math.log((seen[f, r, c] + lm.SMOOTHING * share[c]) / ((times[f, r] + lm.SMOOTHING) * share[c]))
    for k, s in seqs.items():
        want = 0.0
        for one, two, h in contexts(s):
            logits = [math.log(share[c]) + weight(0, one % rows, c) + weight(1, two % rows, c) for c in range(lm.CLASSES)]
            top = sum(map(math.exp, logits))
            want += (logits[kind(h)] - math.log(top)) / math.log(10) + math.log10((counts[h] + 1) / (mass[kind(h)] + 1))
        assert abs(got[k] - want) < 2e-3 * len(s), k
    assert all(abs(sum((c + 1) / (mass[k] + 1) for h, c in counts.items() if kind(h) == k) + 1 / (mass[k] + 1) - 1) < 1e-12 for k in range(lm.CLASSES))


def test_lm_does_not_depend_on_the_split(docs):
    one = {r.doc_id: r.score for r in lm.score(docs.repartition(1), F.lit(True), rounds=2).collect()}
    many = {r.doc_id: r.score for r in lm.score(docs.repartition(7), F.lit(True), rounds=2, block_bytes=100).collect()}
    assert all(abs(one[k] - many[k]) < 1e-2 for k in one)
