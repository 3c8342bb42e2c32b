"""Ranked lexical search over an inverted index in shards: Block-Max MaxScore, and a merge of the shards' best.

1. build(): each task cuts the documents that it reads into shards of about SHARD_POSTINGS postings and writes each shard as
   one row: documents with their lengths, terms with their numbers of documents, and postings in compressed blocks of BLOCK
   (gaps and occurrences in as few bytes as the block needs). Each block carries its last document, its most occurrences and
   its shortest length, so that its best possible score follows under any corpus statistics: shards can be added later.
   There is no shuffle; the table of shards is in the shared scratch folder, some shards a row group, so a task holds few at a time.
2. search(): numbers of the corpus and of the queries' terms are sums over the shards (only those columns are read). Each
   task keeps the best of each query over the shards that it has seen, so what a later shard must reach rises.
   In a shard, terms are ordered by their bound over the whole list. The lists whose bounds together stay below what must be
   reached are non-essential: documents that stand only in those cannot count. Essential lists give the candidates; then each
   non-essential list, the largest bound first, is asked for the candidates alone: those that could not reach the goal even
   with their block's maximum are rejected before the block is decompressed.
3. The tasks' lists of at most k a query meet in two steps of windows, by query and group of tasks and then by query.

Queries are a stated set that goes to every shard: in blocks of at most QUERY_BYTES of text, whatever their number.

Scores are integers, by the formula in weight() and in Shard.gains(); results are exact.

Defined results: a null or empty text has no terms and is in no result; rows that share an id, repeated rows and rows with a
null id are documents of their own (null ids rank behind others of equal score); a query without terms, or none of whose terms
occurs, has no rows; each row of the queries is a query of its own. Long texts are indexed whole; empty tables give an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliometry.llm.common import LARGE_ROWS, mark, materialize, release, slices, texts_of
from foliometry.llm.gather import bounds_of, spread

#: Postings of a block, and postings or documents at which a shard is closed.
BLOCK, SHARD_POSTINGS, SHARD_DOCS = 128, 1 << 20, 1 << 16
#: Bytes of query text that are searched for at a time.
QUERY_BYTES = 16 << 20
#: Groups of tasks whose lists are merged first.
GROUPS = 64

#: Bytes that part terms become blanks, A-Z become a-z.
_FOLDED = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).lower()

SHARDS = (
    "n_docs long, n_terms long, doc_ids array<long>, sizes array<int>, terms array<string>, docs_of array<int>, blocks array<int>, "
    "last array<int>, most array<int>, shortest array<int>, widths array<int>, places array<int>, postings binary"
)


def terms_of(text: str) -> list[bytes]:
    """Runs of letters, digits and all characters beyond ASCII, A-Z lower-cased."""
    return text.encode().translate(_FOLDED).split()


def weight(n_docs: int, docs_of: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * docs_of + 1)))


def packed(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Little-endian bytes of each value, as many as its width says."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < widths[:, None]]


def _width(most: np.ndarray) -> np.ndarray:
    return 1 + (most > 0xFF).astype(np.int64) + (most > 0xFFFF) + (most > 0xFFFFFF)


class Builder:
    """Gathers the documents of a shard and makes its row."""

    def __init__(self, most_postings: int = SHARD_POSTINGS) -> None:
        self.most_postings = most_postings
        self.doc_ids: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.codes: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # term, document, occurrences
        self.postings = 0

    def add(self, doc_ids: list[int | None], texts: list[str]) -> None:
        """Documents without terms are left out: they count nowhere."""
        words = [terms_of(t) for t in texts]
        held = [k for k, w in enumerate(words) if w]
        sizes = np.array([len(words[k]) for k in held], np.int64)
        code = np.fromiter((self.codes[w] for k in held for w in words[k]), np.int64, int(sizes.sum()))
        key = np.repeat(np.arange(len(held)), sizes) << 32 | code
        key, times = np.unique(key, return_counts=True)
        self.found.append(((key & 0xFFFFFFFF).astype(np.int32), ((key >> 32) + len(self.doc_ids)).astype(np.int32), times.astype(np.int32)))
        self.doc_ids += [doc_ids[k] for k in held]
        self.sizes.append(sizes)
        self.postings += len(key)

    @property
    def full(self) -> bool:
        return self.postings >= self.most_postings or len(self.doc_ids) >= SHARD_DOCS

    def row(self) -> dict[str, Any]:
        term, doc, times = (np.concatenate([x[k] for x in self.found]) for k in range(3))
        self.found = []
        order = np.argsort(term, kind="stable")  # documents come in order already
        doc, times, docs_of = doc[order], times[order], np.bincount(term, minlength=len(self.codes))
        del term, order
        sizes = np.concatenate(self.sizes)
        blocks = -(-docs_of // BLOCK)
        per_list = spread(np.zeros(len(blocks), np.int64), blocks)  # each block's number within its list
        starts = np.repeat(np.cumsum(docs_of) - docs_of, blocks) + per_list * BLOCK
        ends = np.append(starts[1:], len(doc))
        first = np.zeros(len(doc), bool)
        first[starts[per_list == 0]] = True
        gaps = doc.copy()
        gaps[1:] -= doc[:-1]
        gaps[first] = doc[first] + 1
        gap_width, times_width = _width(np.maximum.reduceat(gaps, starts)), _width(np.maximum.reduceat(times, starts))
        per_posting = ends - starts
        both = np.stack([gaps, times], axis=1).reshape(-1)
        widths = np.stack([np.repeat(w.astype(np.uint8), per_posting) for w in (gap_width, times_width)], axis=1).reshape(-1)
        return {
            "n_docs": len(sizes), "n_terms": int(sizes.sum()), "doc_ids": self.doc_ids, "sizes": sizes, "terms": [t.decode() for t in self.codes], "docs_of": docs_of, "blocks": blocks, "last": doc[ends - 1],
            "most": np.maximum.reduceat(times, starts), "shortest": np.minimum.reduceat(sizes[doc], starts), "widths": gap_width << 4 | times_width,
            "places": np.cumsum(per_posting * (gap_width + times_width)) - per_posting * (gap_width + times_width), "postings": packed(both, widths).tobytes(),
        }


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in SHARDS.split(", "))])


def _build(most_postings: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, shard = _schema(), Builder(most_postings)

        def closed() -> pa.RecordBatch:
            row = shard.row()
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        for batch in slices(batches, "text", min(2 << 20, 4 * most_postings)):
            shard.add(batch.column(0).to_pylist(), texts_of(batch.column(1)))
            if shard.full:
                yield closed()
                shard = Builder(most_postings)
        if shard.postings:
            yield closed()

    return run


class Shard:
    """A shard's row with what a search needs: lists by term, bounds of blocks, decompression."""

    def __init__(self, row: dict[str, Any], wanted: pa.Array, n_docs: int, n_terms: int) -> None:
        self.doc_ids = row["doc_ids"]
        sizes = row["sizes"].astype(np.int64)
        self.length = 100 - 50 + 50 * sizes * n_docs // n_terms  # m of the formula
        at = np.asarray(pc.index_in(row["terms"], value_set=wanted).fill_null(-1))
        self.list_of = {int(q): k for k, q in enumerate(at) if q >= 0}
        self.first = bounds_of(row["blocks"])
        self.last, self.docs_of = row["last"], row["docs_of"]
        self.widths, self.places, self.postings = row["widths"], row["places"], np.frombuffer(row["postings"], np.uint8)
        self.block_bounds = self.gains(row["most"].astype(np.int64), 50 + 50 * row["shortest"].astype(np.int64) * n_docs // n_terms)
        self.decoded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def gains(times: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a term of weight 1 adds to a document: more occurrences add more, greater length adds less."""
        return 1_000_000_000 * times // (1000 * times + 20 * length)

    def bound(self, k: int) -> int:
        return int(self.block_bounds[self.first[k] : self.first[k + 1]].max())

    def block(self, k: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and gains of block b, which belongs to list k; decompressed once a shard."""
        if b not in self.decoded:
            number = b - int(self.first[k])
            n = min(BLOCK, int(self.docs_of[k]) - number * BLOCK)
            g, t = int(self.widths[b]) >> 4, int(self.widths[b]) & 15
            raw = self.postings[self.places[b] : self.places[b] + n * (g + t)].reshape(n, g + t).astype(np.int64)
            scale = np.int64(1) << 8 * np.arange(4)
            docs = np.cumsum(raw[:, :g] @ scale[:g]) + (int(self.last[b - 1]) if number else -1)
            self.decoded[b] = docs, self.gains(raw[:, g:] @ scale[:t], self.length[docs])
        return self.decoded[b]

    def best(self, query: list[tuple[int, int]], goal: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that reach the goal (or the k best of the shard, where more do), and their scores."""
        lists = sorted((w * self.bound(at), at, w) for term, w in query if w > 0 and (at := self.list_of.get(term)) is not None)
        below = bounds_of([bound for bound, _, _ in lists])  # what the lists before each one can add together
        essential = int(np.searchsorted(below[1:], goal, "left"))
        blocks = [(*self.block(at, b), w) for _, at, w in lists[essential:] for b in range(self.first[at], self.first[at + 1])]
        if not blocks:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, place = np.unique(np.concatenate([d for d, _, _ in blocks]), return_inverse=True)
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, place, np.concatenate([g * w for _, g, w in blocks]))
        for i in range(essential - 1, -1, -1):
            if len(scores) > k:  # the k-th best so far will not fall
                goal = max(goal, int(np.partition(scores, -k)[-k]))
            _, at, w = lists[i]
            blocks_last = self.last[self.first[at] : self.first[at + 1]]
            where = np.searchsorted(blocks_last, docs)
            inside = where < len(blocks_last)
            most = np.where(inside, self.block_bounds[self.first[at] + np.minimum(where, len(blocks_last) - 1)] * w, 0)
            alive = scores + most + below[i] >= goal
            docs, scores, where, inside = docs[alive], scores[alive], where[alive], inside[alive]
            for b in np.unique(where[inside]).tolist():
                own = np.flatnonzero(where == b)
                held, gains = self.block(at, int(self.first[at]) + b)
                found = np.minimum(np.searchsorted(held, docs[own]), len(held) - 1)
                scores[own] += np.where(held[found] == docs[own], gains[found] * w, 0)
        if len(scores) > k:
            goal = max(goal, int(np.partition(scores, -k)[-k]))
        alive = scores >= goal
        return docs[alive], scores[alive]


class Best:
    """The k best (score, doc_id) of a query so far: highest score first, then smallest id, null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []

    @property
    def goal(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: list[int], doc_ids: list[int | None]) -> None:
        self.rows = sorted([*self.rows, *zip(scores, doc_ids, strict=True)], key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.k]


def _search(wanted: list[str], queries: list[list[tuple[int, int]]], n_docs: int, n_terms: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best = [Best(k) for _ in queries]
        terms = pa.array(wanted, pa.string())
        for batch in batches:
            for i in range(len(batch)):
                row = {f.name: batch.column(c)[i] for c, f in enumerate(batch.schema)}
                row = {c: x.as_py() if c in ("doc_ids", "postings", "n_docs", "n_terms") else x.values if c == "terms" else np.asarray(x.values) for c, x in row.items()}
                shard = Shard(row, terms, n_docs, n_terms)
                for query, kept in zip(queries, best, strict=True):
                    docs, scores = shard.best(query, kept.goal, k)
                    if len(docs):
                        kept.add(scores.tolist(), [shard.doc_ids[d] for d in docs])
        rows = [(q, d, s) for q, kept in enumerate(best) for s, d in kept.rows]
        part = TaskContext.get().partitionId() % GROUPS
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int64()), *(pa.array([r[c] for r in rows], pa.int64()) for c in (1, 2))]
        yield pa.RecordBatch.from_arrays(columns, names=["query", "part", "doc_id", "score"])

    return run


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The table of shards of docs, one row a shard."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(_build(most_postings), SHARDS), "shards", LARGE_ROWS)


def _some(shards: DataFrame, items: DataFrame, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """The k best documents of each of these items, which are few enough for one task to hold."""
    spark = shards.sparkSession
    rows = items.collect()
    words = [sorted({w.decode() for w in terms_of(r["text"] or "")}) for r in rows]
    wanted = sorted({w for ws in words for w in ws})
    listed = spark.createDataFrame([(w,) for w in wanted], "term string")
    lists = shards.select(F.explode(F.arrays_zip("terms", "docs_of")).alias("l")).select(F.col("l.terms").alias("term"), F.col("l.docs_of").alias("n"))
    counts = {r["term"]: r["docs"] for r in lists.join(F.broadcast(listed), "term").groupBy("term").agg(F.sum("n").alias("docs")).collect()}
    place = {w: i for i, w in enumerate(wanted)}
    queries = [[(place[w], weight(n_docs, counts[w])) for w in ws if w in counts] for ws in words]
    found = shards.mapInArrow(_search(wanted, queries, n_docs, n_terms, k), "query long, part long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "part")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], "query long, item_id long")
    return materialize(ranked.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score"), "found")


def search(shards: DataFrame, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """For each row of items the k documents of the highest score above 0: item_id, rank, doc_id, score. shards: from build()."""
    total = shards.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where(F.octet_length("text") > 0)
    out = shards.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not total["d"]:
        return out
    parts = math.ceil((items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0) / QUERY_BYTES)
    for part in range(parts):  # one as long as the items' text fits in QUERY_BYTES
        out = out.unionByName(_some(shards, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part), k, total["d"], total["t"]))
    return out


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    spark, since = docs.sparkSession, mark()
    shards = build(docs)
    found = materialize(search(shards, items, 50), "ranked")
    release(spark, since, found)
    return found


SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0
), p AS MATERIALIZED (SELECT r, doc_id, t, len_, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(ts)::BIGINT AS len_, unnest(ts) AS t FROM d) GROUP BY ALL
), w AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t
), i AS (
  SELECT DISTINCT k, item_id, unnest(ts) AS t FROM (
    SELECT row_number() OVER () AS k, item_id,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark)
), s AS (
  SELECT k, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len_ * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN p USING (t) JOIN w USING (t), c GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
) WHERE rank <= 50
"""
