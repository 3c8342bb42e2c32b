"""Token alignment between two tokenizers: token-byte incidence matrices in CSR, multiplied row by row.

A byte-level BPE (A) and a sentencepiece BPE (B) cut the same bytes. With A and B as token-by-byte matrices, the row products
of A times the transpose of B count the bytes that an A token and a B token share: the overlap links. The overlaps cut the
bytes into groups: a group ends where the next A token starts a new B token, which is where tokens of both end. With the
tokens' membership of groups as matrices, the row products of one times the transpose of the other are the shared-group links.
Matrices are built by hand as (row bounds, column numbers); products are made in blocks of rows of bounded size.

1. One pass over the texts, without a shuffle: each row's numbers, the digest of its groups, and its distinct linked id pairs
   with how often each occurs. The result is a table in the shared scratch folder.
2. The corpus-wide count of an id pair is the number of rows that hold it (partial counts before the shuffle); the pairs with
   the highest count of their A id are marked.
3. Rows meet the counts of their pairs: the most frequent pairs, BROADCAST_PAIRS at most, by broadcast, the others by
   shuffle, and each row's sums come from partial sums.

Defined results: rows whose text is null or empty, or whose tokens of A or of B do not lay out as the blank and the text, have
no tokens: zeros and an empty digest. Repeated rows, rows that share an id and rows with a null id are documents of their own.
Long texts are aligned whole; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliometry.llm.common import mark, materialize, release, slices, texts_of
from foliometry.llm.gather import WordIds, bounds_of, byte_runs, matches, spread

#: Products of matrix rows that are held at a time.
MOST_PRODUCTS = 1 << 21
#: Id pairs (24 bytes each) whose counts are broadcast, those with the highest counts first.
BROADCAST_PAIRS = 1_000_000
PAIR_BITS = 32
#: How byte-level BPE of this kind cuts texts (fixed value).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Csr:
    """A sparse 0/1 matrix: row i has ones in the columns indices[indptr[i]:indptr[i + 1]]."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int

    @classmethod
    def of_runs(cls, lengths: np.ndarray) -> Csr:
        """Rows that share out the columns one after the other: tokens by bytes."""
        indptr = bounds_of(lengths)
        return cls(indptr, np.arange(indptr[-1]), int(indptr[-1]))

    @classmethod
    def of_owners(cls, owners: np.ndarray, columns: int) -> Csr:
        """A single one in each row: tokens by groups."""
        return cls(np.arange(len(owners) + 1), owners, columns)

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        sorted_already = bool((self.indices[1:] >= self.indices[:-1]).all())
        order = slice(None) if sorted_already else np.argsort(self.indices, kind="stable")
        return Csr(bounds_of(np.bincount(self.indices, minlength=self.columns)), rows[order], len(self.indptr) - 1)


def row_products(left: Csr, right: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The product of two matrices by Gustavson's method: (row, column, value) of its entries, in blocks of rows.

    Row i of the product is the sum of the rows of right that row i of left names; equal columns are added up. A block has
    about MOST_PRODUCTS terms, more only where a single row does.
    """
    fan = np.diff(right.indptr)[left.indices]
    terms = bounds_of(fan)[left.indptr]  # terms before each row of left
    row = 0
    while row < len(left.indptr) - 1:
        stop = max(row + 1, int(np.searchsorted(terms, terms[row] + MOST_PRODUCTS, "right")) - 1)
        entries = slice(left.indptr[row], left.indptr[stop])
        owner = np.repeat(np.repeat(np.arange(row, stop), np.diff(left.indptr[row : stop + 1])), fan[entries])
        column = right.indices[spread(right.indptr[left.indices[entries]], fan[entries])]
        key = owner * right.columns + column
        if not (key[1:] >= key[:-1]).all():
            key.sort()
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        yield key[new] // right.columns, key[new] % right.columns, np.diff(np.append(new, len(key)))
        row = stop


def overlaps(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, shared bytes) of all tokens that share a byte; the tokens of both lie over the same bytes in order."""
    found = list(row_products(Csr.of_runs(size_a), Csr.of_runs(size_b).transposed()))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for k in range(3))  # type: ignore[return-value]


def groups_of(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray, int]:
    """From overlap links, in order of a and then b: the group of each A token and of each B token, and the number of groups."""
    first, last = np.full(n_a, n_b), np.full(n_a, -1)
    np.minimum.at(first, a, b)
    np.maximum.at(last, a, b)
    opens = np.ones(n_a, bool)
    opens[1:] = first[1:] > last[:-1]
    group_a = np.cumsum(opens) - 1
    group_b = np.zeros(n_b, np.int64)
    group_b[b] = group_a[a]
    return group_a, group_b, int(opens.sum())


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def end_to_end(encoded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    bounds = bounds_of(np.fromiter(map(len, encoded), np.int64, len(encoded)))
    return np.fromiter(chain.from_iterable(encoded), np.int64, int(bounds[-1])), bounds


class ByteLevel:
    """A tokenizers file of byte-level BPE."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        byte = byte_letters()
        vocabulary = {i: t for t, i in self.model.get_vocab(with_added_tokens=True).items()}
        self.size = max(vocabulary) + 1
        raw = [bytes(map(byte.get, t)) if set(t) <= byte.keys() else t.encode() for t in (vocabulary.get(i, "") for i in range(self.size))]
        self.bytes = byte_runs(raw)

        # pre-tokens are encoded each by itself where nothing but the usual pattern cuts the texts
        steps = json.loads(self.model.to_str())
        cut = steps["pre_tokenizer"] or {}
        plain = steps["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
        self.by_word = WordIds(matches(regex.compile(PRE_TOKENS)), self._encode) if plain else None

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts with a blank before each, and each text's bounds."""
        texts = [" " + t for t in texts]
        return self.by_word(texts) if self.by_word else end_to_end(self._encode(texts))


class Pieces:
    """A sentencepiece file, which adds the blank before a text itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = byte_runs([bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

        # stretches of blanks with what follows are encoded each by itself where no piece has a blank behind another character
        across = any("▁" in p.lstrip("▁") for p in pieces)
        self.by_word = None if across else WordIds(matches(re.compile(" +[^ ]*")), self._encode)
        self.blank = self.model.piece_to_id("▁")

    def _encode(self, words: list[str]) -> list[list[int]]:
        """Ids of words that begin with a blank, which the model adds by itself."""
        return [ids or [self.blank] for ids in self.model.encode([w[1:] for w in words], num_threads=1)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts with a blank before each, and each text's bounds."""
        if self.by_word is None or any("▁" in t for t in texts):
            return end_to_end(self.model.encode(texts, num_threads=1))
        return self.by_word([" " + t for t in texts])


class Tokens:
    """Tokens of several texts end to end: ids, sizes in bytes, and where each text's tokens begin and end."""

    def __init__(self, tokenizer: ByteLevel | Pieces, texts: list[str]) -> None:
        ids, self.bounds = tokenizer.encode(texts)
        self.ids = ids.astype(np.int64)
        self.raw, self.sizes = tokenizer.bytes.gather(self.ids)

    def equal(self, texts: list[bytes]) -> list[bool]:
        """For each text, whether the tokens' bytes are these."""
        at = bounds_of(self.sizes)[self.bounds]
        return [j - i == len(t) and self.raw[i:j].tobytes() == t for t, i, j in zip(texts, at, at[1:], strict=False)]

    def keep(self, those: np.ndarray) -> None:
        kept = np.repeat(those, np.diff(self.bounds))
        self.ids, self.sizes, self.bounds = self.ids[kept], self.sizes[kept], bounds_of(np.diff(self.bounds)[those])
        self.raw = self.raw[:0]

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


class Aligner:
    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        tokens = [*range(self.a.size), *range(self.b.size)]
        # each token's text in a digest, by what follows it
        self.shown = np.array([f"{i}{end}" for ends in (",|", ",;") for i in (tokens[: self.a.size] if ends == ",|" else tokens[self.a.size :]) for end in ends], object)

    def tokens(self, texts: list[str]) -> tuple[Tokens, Tokens, np.ndarray]:
        """Tokens of the texts that both lay out as they are, and the places of those texts."""
        some = [i for i, t in enumerate(texts) if t]
        live = [texts[i] for i in some]
        want = [b" " + t.encode() for t in live]
        a, b = Tokens(self.a, live), Tokens(self.b, live)
        good = np.array([x and y for x, y in zip(a.equal(want), b.equal(want), strict=True)], bool)
        a.keep(good)
        b.keep(good)
        return a, b, np.array(some, np.int64)[good]

    def digests(self, a: Tokens, b: Tokens, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
        """For each text sha256 of its groups: ids of A, a bar, ids of B, and a semicolon between groups."""
        last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(group_a)]
        last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(group_b)]
        n_a, n_b = np.bincount(group_a, minlength=1), np.bincount(group_b, minlength=1)
        place = np.zeros(len(group_a) + len(group_b), np.int64)
        place[np.arange(len(group_a)) + (np.cumsum(n_b) - n_b)[group_a]] = 2 * a.ids + last_a
        place[np.arange(len(group_b)) + np.cumsum(n_a)[group_b]] = 2 * (self.a.size + b.ids) + last_b
        bounds = a.bounds + b.bounds
        return [hashlib.sha256("".join(self.shown[place[i:j]].tolist())[:-1].encode()).hexdigest() for i, j in zip(bounds, bounds[1:], strict=False)]

    def __call__(self, texts: list[str]) -> dict[str, Any]:
        """Columns of the rows: numbers, digest, and the distinct linked pairs with their numbers of links."""
        a, b, rows = self.tokens(texts)
        over_a, over_b, _ = overlaps(a.sizes, b.sizes)
        group_a, group_b, n_groups = groups_of(over_a, over_b, len(a.ids), len(b.ids))
        owner, size_b = a.owner, np.int64(self.b.size)
        span = np.int64(self.a.size) * size_b
        keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        members_a, members_b = Csr.of_owners(group_a, n_groups), Csr.of_owners(group_b, n_groups).transposed()
        for i, j, shared in row_products(members_a, members_b):
            found, at = np.unique(owner[i] * span + a.ids[i] * size_b + b.ids[j], return_inverse=True)
            keys.append(found)
            times.append(np.bincount(at, shared, len(found)).astype(np.int64))
        pairs, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, at, np.concatenate(times))

        n = len(texts)
        out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        out["n_a"][rows], out["n_b"][rows] = np.diff(a.bounds), np.diff(b.bounds)
        first = np.unique(group_a, return_index=True)[1]
        out["n_groups"][rows] = np.bincount(owner[first], minlength=len(rows))
        whose = pairs // span
        np.add.at(out["n_links"], rows[whose], counts)
        digests = np.full(n, "", object)
        digests[rows] = self.digests(a, b, group_a, group_b)
        held = np.zeros(n, np.int64)
        held[rows] = np.bincount(whose, minlength=len(rows))
        within = pairs % span
        codes = (within // size_b << PAIR_BITS) | within % size_b
        entries = pa.StructArray.from_arrays([pa.array(codes), pa.array(counts)], names=["pair", "times"])
        return out | {"groups_sha256": digests.tolist(), "links": pa.ListArray.from_arrays(pa.array(bounds_of(held).astype(np.int32)), entries)}


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(path_a, path_b)


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair:long,times:long>>"


def _align(path_a: str, path_b: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", 1 << 20):
            found = aligner(path_a, path_b)(texts_of(batch.column(1)))
            found |= {"row": np.arange(row, row + len(batch)), "doc_id": batch.column(0)}
            row += len(batch)
            names = [f.split()[0] for f in ALIGNED.split(", ")]
            yield pa.RecordBatch.from_arrays([x if isinstance(x := found[c], pa.Array) else pa.array(x) for c in names], names=names)

    return run


def _overlap_rows(path_a: str, path_b: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            a, b, rows = aligner(path_a, path_b).tokens(texts_of(batch.column(1)))
            i, j, shared = overlaps(a.sizes, b.sizes)
            whose = a.owner[i]
            ids = batch.column(0).take(pa.array(rows[whose]))
            columns = [i - a.bounds[whose], j - b.bounds[whose], a.ids[i], b.ids[j], shared]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names=["doc_id", "a_at", "b_at", "a_id", "b_id", "n_bytes"])

    return run


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def overlap_links(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each two tokens that share bytes: doc_id, places and ids of both, n_bytes. path_a: byte-level BPE, path_b: sentencepiece."""
    return _rows(docs, doc_id, text).mapInArrow(_overlap_rows(path_a, path_b), "doc_id long, a_at long, b_at long, a_id long, b_id long, n_bytes long")


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: row (unique), doc_id, numbers of tokens, groups and links, groups_sha256, and its links by id pair.

    A pair is the id of A, shifted by PAIR_BITS, with the id of B; times is the number of its links in the document.
    """
    return _rows(docs, doc_id, text).mapInArrow(_align(path_a, path_b), ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Of align(): pair, docs (rows that hold it) and best (docs is the highest of the pair's A id, ties included)."""
    counts = aligned.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    counts = materialize(counts, "pairs")
    of_a = F.shiftright("pair", PAIR_BITS)
    most = counts.groupBy(of_a.alias("a")).agg(F.max("docs").alias("most"))
    return counts.join(most, of_a == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def scored(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """align() with each document's n_best and count_sum over its links."""
    spark, since = docs.sparkSession, mark()
    aligned = materialize(align(docs, path_a, path_b, doc_id, text), "aligned")
    counts = materialize(pair_counts(aligned), "counts")
    many = counts.count() > BROADCAST_PAIRS
    first = materialize(counts.orderBy(F.desc("docs"), "pair").limit(BROADCAST_PAIRS), "first") if many else counts
    release(spark, since, aligned, counts, first)
    links = aligned.select("row", F.explode("links").alias("l")).select("row", "l.pair", "l.times")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("docs") * F.col("times")).alias("count_sum")]
    near = links.join(F.broadcast(first), "pair").groupBy("row").agg(*sums)
    if many:
        rest = links.join(F.broadcast(first.select("pair")), "pair", "left_anti")
        far = rest.join(counts.join(first.select("pair"), "pair", "left_anti"), "pair").groupBy("row").agg(*sums)
        near = near.union(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = aligned.drop("links").join(near, "row", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    found = scored(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
