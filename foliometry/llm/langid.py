"""Language identification by hyperdimensional n-gram profiles.

Each letter has a random +-1 vector, drawn from its code point. A trigram's vector binds (multiplies) the letters'
vectors, each permuted (rotated) by its place in the trigram; a text's vector bundles (adds) the vectors of all its
trigrams; a language's prototype bundles texts known to be of it. A text is given the language of the prototype with the
largest cosine.

Training takes a bounded sample of labelled texts of each language (max_train_docs, chosen by a hash of the text), so a rare
language is learned from all its texts however large the others are; each task adds up the vectors of its own texts, and a
partial sum per language and task is all that is shuffled. The prototypes (one vector of `dims` numbers per language,
MOST_LANGS at most) reach the driver and go out to the tasks with the scoring function. Scoring reads every text once, in
whole, and shuffles nothing; the filter of the pipeline passes whole rows through, so ids play no part in it.

Defined results: und with score 0 where the text is null or has no letter, or where nothing was learned; a null lang
is not learned from; equal cosines go to the first language in sorted order; repeated rows are scored alike, each row by
its own text, whatever its id; a null id stays null; a cosine below 0 scores 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliometry.llm.common import M1, fold, mix, slices

#: Numbers of a vector, texts learned from in each language, and languages.
DIMS, MAX_TRAIN_DOCS, MOST_LANGS = 1024, 5_000, 1000
#: Trigram vectors that a task keeps; DIMS bytes each.
KEPT = 30_000
#: Trigrams of a text that are bundled at a time, which bounds what a long text takes.
PART = 2048
EDGE = 32
#: The cosine of unrelated texts is about normal with deviation 1 / sqrt(DIMS); three deviations are noise.
MIN_SCORE = 3 / DIMS**0.5


def letter_vectors(points: np.ndarray, dims: int) -> np.ndarray:
    """One +-1 vector for each code point."""
    seeds = mix(points.astype(np.uint64) * M1 + np.uint64(0x1234567))
    bits = mix(seeds[:, None] + np.arange(1, dims // 64 + 1, dtype=np.uint64)[None, :] * M1)
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def trigram_vectors(grams: np.ndarray, dims: int) -> np.ndarray:
    """Trigrams, 21 bits a letter, to bound vectors."""
    out = np.ones((len(grams), dims), np.int8)
    for place in range(3):
        points, at = np.unique((grams >> np.uint64(21 * (2 - place))) & np.uint64((1 << 21) - 1), return_inverse=True)
        out *= np.roll(letter_vectors(points, dims), 2 - place, axis=1)[at]
    return out


_LETTER = np.zeros(0, bool)


def _letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER[points]


class Bundler:
    """Text vectors; keeps the vectors of trigrams that it has seen."""

    def __init__(self, dims: int) -> None:
        self.dims = dims
        self.vectors = np.zeros((1024, dims), np.int8)
        self._clear()

    def _clear(self) -> None:
        self.grams, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _places(self, grams: np.ndarray) -> np.ndarray:
        """Rows of sorted distinct trigrams in `vectors`; unknown ones get their vectors."""
        at = np.searchsorted(self.grams, grams)
        new = grams if not len(self.grams) else grams[self.grams[np.minimum(at, len(self.grams) - 1)] != grams]
        if len(new):
            if len(self.grams) + len(new) > KEPT:
                self._clear()
                new = grams
            used = len(self.grams)
            if used + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros((max(len(self.vectors), len(new)), self.dims), np.int8)])
            self.vectors[used : used + len(new)] = trigram_vectors(new, self.dims)
            spot = np.searchsorted(self.grams, new)
            self.grams, self.rows = np.insert(self.grams, spot, new), np.insert(self.rows, spot, np.arange(used, used + len(new)))
            at = np.searchsorted(self.grams, grams)
        return self.rows[at]

    def __call__(self, text: str | None) -> np.ndarray | None:
        """The bundle of the text's trigrams, None without letters. Words are lower-cased runs of letters with an edge."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters(points)
        if not letter.any():
            return None
        symbols = np.concatenate([[EDGE], np.where(letter, points, EDGE), [EDGE]]).astype(np.uint64)
        edge = symbols == EDGE
        symbols = symbols[np.concatenate([[True], ~(edge[1:] & edge[:-1])])]
        grams, counts = np.unique((symbols[:-2] << np.uint64(42)) | (symbols[1:-1] << np.uint64(21)) | symbols[2:], return_counts=True)
        total = np.zeros(self.dims, np.float32)
        for i in range(0, len(grams), PART):
            part = grams[i : i + PART]
            places = self._places(part)
            total += counts[i : i + PART].astype(np.float32) @ self.vectors[places].astype(np.float32)
        return total


def _sums(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, sums = Bundler(dims), {}
        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = bundle(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + v / max(np.linalg.norm(v), 1e-9)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "total": [s.astype(float).tolist() for s in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("total", pa.list_(pa.float64()))]))

    return run


def train(docs: DataFrame, usable: Column, lang: str = "lang", text: str = "text", dims: int = DIMS, max_train_docs: int = MAX_TRAIN_DOCS) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from about max_train_docs of the usable rows of each language at most."""
    rows = docs.where(usable & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if large := {r["lang"]: int(1_000_000 * max_train_docs / r["count"]) for r in counts if r["count"] > max_train_docs}:
        rate = F.create_map(*[F.lit(x) for pair in large.items() for x in pair])[F.col("lang")]
        rows = rows.where(F.pmod(F.xxhash64(F.lit(8), "text"), F.lit(1_000_000)) < F.coalesce(rate, F.lit(1_000_000)))
    sums = rows.mapInArrow(_sums(dims), "lang string, total array<double>")
    added = sums.select("lang", F.posexplode("total").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    found = added.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("v")).select("lang", "v.v").collect()
    return {r.lang: np.array(r.v) / max(np.linalg.norm(r.v), 1e-9) for r in found}


class Scorer:
    """Languages and cosines of the texts of a batch."""

    def __init__(self, prototypes: dict[str, np.ndarray]) -> None:
        self.langs = sorted(prototypes)
        self.table = np.array([prototypes[k] for k in self.langs], np.float64) if self.langs else np.zeros((0, DIMS))

    def start(self) -> Bundler:
        return Bundler(self.table.shape[1])

    def __call__(self, bundle: Bundler, texts: pa.Array) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for t in texts.to_pylist():
            v = bundle(t) if self.langs else None
            if v is None:
                names.append("und")
                scores.append(0.0)
            else:
                cosines = self.table @ v / max(float(np.linalg.norm(v)), 1e-9)
                best = int(np.argmax(cosines))
                names.append(self.langs[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
        return names, scores


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine with the language's prototype, 0 to 1)."""
    score = Scorer(prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = score.start()
        for batch in slices(batches, "text"):
            names, scores = score(bundle, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    prototypes = train(docs, fold("doc_id", 3) != 1)
    out = predict(docs, prototypes)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE, text: str = "text") -> DataFrame:
    """docs without those that language identification rejects: no letter, or no likeness to any language.

    Where nothing was learned, only texts without a letter go.
    """
    score = Scorer(train(docs, F.lit(True), text=text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = score.start()
        for batch in slices(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            if score.langs:
                names, scores = score(bundle, column)
                stays = [n != "und" and s >= min_score for n, s in zip(names, scores, strict=True)]
            else:
                stays = [any(map(str.isalpha, t or "")) for t in column.to_pylist()]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
