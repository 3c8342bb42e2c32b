"""Near-duplicate documents by MinHash with tensored banding.

Two small collections A and B of band hashes are taken from each document's shingle set; the key of table (i, j)
combines A_i with B_j. With m collections of r minhashes each, m * m tables of 2r rows cost only 2 * m * r minhashes:
about the square root of what independent bands would. Two documents of similarity s meet in some table with
probability (1 - (1 - s^r)^m)^2; with r = 3 and m = 14 that is above 0.9999 at s = 0.8 and 0.10 at s = 0.3.

1. Tasks turn texts into signatures (Arrow batches, numpy). Documents with equal sets are one class, known by 64 bits of
   the set's hash, and only one row a class goes on, so a group of copies of any size costs one row per table.
2. Band hashes that no other class has are dropped (2 * m rows a class); the tables of what is left get their keys.
3. Rows of a bucket meet the smallest class in it (minima per bucket are partial aggregates; the join back is one that
   AQE can split); each class is compared with the one that it meets most often, on the full sets. Then the buckets of A's
   bands whose members are in more than one component get a centre, in STARS - 1 rounds; of buckets with the same members one goes on.
4. The classes that share a band of A and are still in more than one component are compared: a bucket of two gives its pair,
   if that was not compared before; larger ones are compared in blocks, where each pair of parts of at most about BLOCK classes
   is a group, which reads the sets and gives only links that connect components. A component that fills blocks of its own is
   not compared with itself. Each pair that meets in some table and is still apart is compared at the first band of A that it
   shares, whatever that bucket's size, so no link that a table shows is lost; pairs of larger buckets are never emitted.

Results of each step are tables in the shared scratch folder; those that the result does not read are deleted.

Defined results: a null, empty or blank text has an empty set and links with nothing; fewer words than the width make one
shingle of the whole sequence; a row with a null id is not linked: its component is null and it is kept; every row has a row
in the result, by its own text, also where rows share an id; component_id is the smallest id among the rows of the
component; an empty table gives an empty result. Sets hold 64-bit hashes of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliometry.llm.common import BROADCAST_IDS, M1, connected_components, free_name, mark, materialize, mix, release, slices, without, word_hashes

#: Classes in each of the two parts of a bucket that one task compares.
BLOCK = 512
#: Rounds of centres before the rest of a bucket is compared in blocks.
STARS = 3
#: Bytes of exploded band hashes for each task.
SPREAD_BYTES = 32 << 20


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their bounds."""
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - bounds[:-1][owner]
    rolled = np.zeros(len(words), np.uint64)
    size = np.minimum(counts, width)[owner]
    for k in range(width):
        at = np.flatnonzero(k < size)
        at = at[at + k < len(words)]
        rolled[at] = mix(rolled[at] + words[at + k] * M1 + np.uint64(k + 1))
    whole = place + width <= counts[owner]
    whole |= (place == 0) & (counts[owner] < width)
    hashes, owner = rolled[whole], owner[whole]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def band_hashes(hashes: np.ndarray, bounds: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """(texts with shingles) x bands: each entry combines `rows` minhashes."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * M1 + np.uint64(seed))
    out = np.zeros((len(starts), bands), np.uint64)
    for band in range(bands):
        for row in range(rows):
            k = 2 * (band * rows + row)
            low = np.minimum.reduceat((hashes ^ seeds[k]) * (seeds[k + 1] | np.uint64(1)), starts)
            out[:, band] = mix(out[:, band] + low)
    return out


def _class_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits of each set's hash; 0 for an empty set."""
    n = np.diff(bounds)
    some = np.flatnonzero(n > 0)
    out = np.zeros(len(n), np.uint64)
    if len(some):
        sums = [np.add.reduceat(mix(hashes ^ np.uint64(k * 0x5851F42D4C957F2D)), bounds[:-1][some]) for k in (1, 2)]
        out[some] = np.maximum(mix(sums[0] ^ mix(sums[1] + n[some].astype(np.uint64))), np.uint64(1))
    return out


def _signatures(width: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, bounds = shingle_sets(batch.column(2), width)
            n = np.diff(bounds)
            some = np.flatnonzero(n > 0)
            full = np.zeros((len(n), 2 * bands), np.uint64)
            for side, seed in enumerate((11, 29)):
                if len(some):
                    full[some, side * bands : (side + 1) * bands] = band_hashes(hashes, bounds, bands, rows, seed)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * bands * len(n) + 1, 2 * bands, dtype=np.int32)), pa.array(full.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(_class_ids(hashes, bounds).view(np.int64)), lists], names=["doc_id", "text_hash", "n_shingles", "node", "bands"]
            )

    return run


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, bounds = shingle_sets(batch.column(0), width)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_class_ids(hashes, bounds).view(np.int64)), lists], names=["node", "shingles"])

    return run


def _sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The full shingle sets of these distinct nodes, from the text of the smallest id of each."""
    wanted = materialize(classes.join(nodes, "node").select("node", F.col("rep").alias("doc_id")), "candidates")
    few = wanted.count() <= BROADCAST_IDS
    hint = F.broadcast if few else (lambda df: df)
    texts = docs.select("doc_id", "text").join(hint(wanted.select("doc_id").distinct()), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(_sets(width), "node long, shingles array<long>").join(hint(wanted.select("node")), "node", "left_semi")
    return materialize(sets.dropDuplicates(["node"]), "sets")


def _best(pairs: DataFrame) -> DataFrame:
    """For each b the a that it meets most often: (a, b)."""
    met = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).groupBy("b").agg(F.max(F.struct("n", "a")).alias("m"))
    return materialize(met.select(F.col("m.a").alias("a"), "b"), "pairs")


def _verified(sets: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """Of the candidate pairs (a, b) those whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    held = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("n"))
    return materialize(held.where(100 * F.col("both") >= threshold * (F.col("n") - F.col("both"))).select("a", "b"), "links")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the bounds of its rows."""
    column = column.combine_chunks()
    offsets = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.flatten()), offsets - offsets[0]


def _compare(threshold: int) -> Callable[[pa.Table], pa.Table]:
    """Two parts of a bucket of a band of A: links between components, as many as connect them.

    The sets are bit sets over the shingles of the two parts.
    """

    def run(rows: pa.Table) -> pa.Table:
        i, u, v = (rows[c][0].as_py() for c in ("i", "u", "v"))
        doc, component, part = (np.asarray(rows[c]) for c in ("node", "component", "part"))
        shingles, bounds = _lists(rows["shingles"])
        n = np.diff(bounds)
        _, place = np.unique(shingles, return_inverse=True)
        bits = np.zeros((len(doc), (int(place.max()) >> 6) + 1 if len(place) else 1), np.uint64)
        np.bitwise_or.at(bits, (np.repeat(np.arange(len(doc)), n), place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        left, right = np.flatnonzero(part == u), np.flatnonzero(part == v)
        wanted = component[left][:, None] != component[right][None, :]
        wanted &= 100 * np.minimum(n[left][:, None], n[right]) >= threshold * np.maximum(n[left][:, None], n[right])
        if u == v:
            wanted &= np.triu(np.ones_like(wanted), 1)
        # compared where the pair first shares a band of A, if it shares one of B as well, so in some table
        bands = _lists(rows["bands"])[0].reshape(len(doc), -1)
        half = bands.shape[1] // 2
        for k in range(i):
            wanted &= bands[left, k][:, None] != bands[right, k][None, :]
        table = np.zeros_like(wanted)
        for k in range(half, 2 * half):
            table |= bands[left, k][:, None] == bands[right, k][None, :]
        wanted &= table
        p, q = np.nonzero(wanted)
        p, q = left[p], right[q]
        both = np.zeros(len(p), np.int64)
        step = max(1, (1 << 22) // bits.shape[1])
        for k in range(0, len(p), step):
            both[k : k + step] = np.bitwise_count(bits[p[k : k + step]] & bits[q[k : k + step]]).sum(axis=1, dtype=np.int64)
        held = 100 * both >= threshold * (n[p] + n[q] - both)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        kept = []
        for x, y in zip(p[held].tolist(), q[held].tolist(), strict=True):
            s, t = find(int(component[x])), find(int(component[y]))
            if s != t:
                root[max(s, t)] = min(s, t)
                kept.append((x, y))
        return pa.table({"a": pa.array([int(doc[x]) for x, _ in kept], pa.int64()), "b": pa.array([int(doc[y]) for _, y in kept], pa.int64())})

    return run


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of buckets with more than one component, with the bucket's size; of buckets with the same members only those of the first table."""
    per = rows.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.min("i").alias("table"),
        *[F.bit_xor(F.xxhash64(F.lit(salt), "node")).alias(f"m{salt}") for salt in (1, 2)],
    ).where("low <> high")
    first = Window.partitionBy("m1", "m2", "size").orderBy("table")
    kept = materialize(per.withColumn("place", F.row_number().over(first)).where("place = 1").select("key", "size"), "mixed")
    return rows.join(kept, "key")


def _twos(rows: DataFrame, reps: DataFrame, tried: list[DataFrame], bands: int) -> DataFrame:
    """The pairs (a, b) of buckets of two that meet in some table, so share a band of B as well, and were not compared before."""
    pairs = rows.where("size = 2").groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b")
    for before in tried:
        pairs = pairs.join(before.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    side = [reps.select(F.col("node").alias(n), F.slice("bands", bands + 1, bands).alias(f"b{n}")) for n in "ab"]
    met = F.exists(F.zip_with("ba", "bb", lambda x, y: x == y), lambda x: x)
    return pairs.join(side[0], "a").join(side[1], "b").where(met).select("a", "b")


def _open_blocks(rows: DataFrame) -> DataFrame:
    """Rows of mixed buckets, dealt to pairs (u, v) of parts that hold pairs to compare.

    A component of BLOCK or more rows in a bucket has parts of its own, which do not meet each other; the rest shares parts.
    """
    per = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    groups = per.groupBy("key", F.when(F.col("n") >= BLOCK, F.col("component")).alias("own")).agg(F.sum("n").alias("n"))
    groups = materialize(groups.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")), "groups")
    mixed = groups.groupBy("key").agg(F.sum("parts").cast("int").alias("all"))
    order = Window.partitionBy("key").orderBy(F.col("own").asc_nulls_first())
    ends = groups.join(mixed.select("key", "all"), "key").withColumn("end", F.sum("parts").over(order).cast("int"))
    ends = materialize(ends.select("key", "own", "parts", "all", "end"), "ends")
    marked = rows.join(per, ["key", "component"]).withColumn("own", F.when(F.col("n") >= BLOCK, F.col("component"))).drop("n").alias("r")
    e = ends.alias("e")
    met = marked.join(e, (F.col("r.key") == F.col("e.key")) & F.col("r.own").eqNullSafe(F.col("e.own")))
    met = met.select("r.key", "i", "node", "component", "r.own", "parts", "all", "end")
    met = met.withColumn("part", F.col("end") - F.col("parts") + F.pmod(F.xxhash64(F.lit(3), "node"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("all") - 1)))
    met = met.where(F.col("own").isNull() | (F.col("other") < F.col("end") - F.col("parts")) | (F.col("other") >= F.col("end")))
    return met.select("key", "i", "node", "component", "part", F.least("part", "other").alias("u"), F.greatest("part", "other").alias("v"))


def _labelled(docs: DataFrame, width: int, threshold: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """Each row's doc_id, text_hash, n_shingles, node (0: empty set), component_id and kept."""
    spark, since = docs.sparkSession, mark()
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    signed = materialize(docs.mapInArrow(_signatures(width, bands, rows), "doc_id long, text_hash long, n_shingles long, node long, bands array<long>"), "signatures")
    linkable = signed.where("node <> 0 and doc_id is not null")
    classes = materialize(linkable.groupBy("node").agg(F.min("doc_id").alias("rep")), "classes")
    n = classes.count()
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(n * 2 * bands * 24 / SPREAD_BYTES))
    reps = materialize(linkable.select("node", "bands").dropDuplicates(["node"]).repartition(tasks, "node"), "reps")

    half = reps.repartition(tasks, "node").select("node", F.posexplode("bands").alias("k", "x")).select("node", "k", F.xxhash64("k", "x").alias("h"))
    met = half.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("h")
    live = half.join(materialize(met, "met"), "h").groupBy("node").agg(F.collect_list(F.struct("k", "h")).alias("l"))
    live = materialize(live.select("node", F.filter("l", lambda x: x["k"] < bands).alias("a"), F.filter("l", lambda x: x["k"] >= bands).alias("b")).where("size(a) > 0 and size(b) > 0"), "live")
    keyed = live.repartition(tasks, "node").select("node", F.explode("a").alias("a"), "b").select("node", "a", F.explode("b").alias("b"))
    keyed = keyed.select("node", F.col("a.k").alias("i"), (F.col("b.k") - bands).alias("j"), F.xxhash64("a.h", "b.h").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last")
    buckets = materialize(buckets.select("key", "centre"), "keys")
    shared = materialize(keyed.join(buckets, "key"), "buckets")

    sets = _sets_of(docs, classes, shared.select("node").distinct(), width)
    tried = [_best(shared.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")))]
    links = _verified(sets, tried[0], threshold)

    # what is still open is looked at by bands of A, of which a class has m and not the tables' m * m
    bands_a = live.select("node", F.explode("a").alias("a")).select("node", F.col("a.k").alias("i"), F.col("a.h").alias("key"))
    bands_a = materialize(bands_a.join(sets.select("node"), "node", "left_semi"), "bands")
    for turn in range(1, STARS + 1):
        labels = connected_components(links)
        rows_ = bands_a.join(labels, "node", "left").select("key", "i", "node", F.coalesce("component", "node").alias("component"))
        rows_ = materialize(_mixed(rows_), "rows")
        many = rows_.where("size > 2")
        if turn == STARS or not many.take(1):
            break
        # another centre in each bucket that is still open: the smallest after some bits are flipped
        flip = F.lit(turn * 0x3A7C5E19B4D26F83 % (1 << 63))
        centres = many.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(flip)).bitwiseXOR(flip).alias("a"))
        centres = centres.join(labels.toDF("a", "other"), "a", "left").withColumn("other", F.coalesce("other", "a"))
        apart = many.join(centres, "key").where("component <> other").select("a", F.col("node").alias("b"))
        tried.append(_best(apart))
        links = materialize(links.union(_verified(sets, tried[-1], threshold)), "links")
    found = [_verified(sets, _twos(rows_, reps, tried, bands), threshold)]
    dealt = materialize(_open_blocks(many), "open")
    if dealt.take(1):
        wide = dealt.join(sets.join(reps, "node"), "node")
        found.append(materialize(wide.groupBy("key", "u", "v").applyInArrow(_compare(threshold), "a long, b long").distinct(), "links"))
    if any(more.take(1) for more in found):
        labels = connected_components(materialize(reduce(DataFrame.union, found, links), "links"))
    # the smallest id of each component
    owners = classes.join(labels, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    smallest = owners.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = materialize(owners.join(smallest, "component").select("node", "component_id"), "ids")
    members = materialize(signed.drop("bands"), "members")
    release(spark, since, ids, members)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = members.join(ids, "node", "left").withColumn("component_id", own)
    return out.select("doc_id", "text_hash", "n_shingles", "node", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80, bands: int = 14, rows: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. threshold: similarity in percent."""
    return _labelled(docs, width, threshold, bands, rows, doc_id, text).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80, bands: int = 14, rows: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group: of the smallest id, and among its rows of the smallest hash of the text.

    Of rows alike in id and text one stays; rows that share an id but neither text nor group all stay.
    """
    labelled = materialize(_labelled(docs, width, threshold, bands, rows, doc_id, text).where("doc_id is not null"), "labelled")
    kept = labelled.where("kept").groupBy("doc_id", "node").agg(F.min("text_hash").alias("first"), F.count("*").alias("rows"))
    several = materialize(kept.where("rows > 1"), "several")
    rest = labelled.where("kept").join(several, ["doc_id", "node"]).where("text_hash <> first")
    gone = labelled.where("not kept").select("doc_id", "text_hash").union(rest.select("doc_id", "text_hash")).distinct()
    key = [F.col(doc_id).cast("long"), F.xxhash64(text)]
    out = without(docs, gone, *key)
    if several.take(1):  # rows alike in id and text
        many = several.select("doc_id", "first").distinct()
        hidden = [free_name(docs, f"__key{k}") for k in range(2)]
        again = out.select("*", *[c.alias(h) for c, h in zip(key, hidden, strict=True)]).join(many.toDF(*hidden), hidden, "left_semi")
        out = without(out, many, *key).unionByName(again.dropDuplicates(hidden).drop(*hidden))
    return out


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, width=4, threshold=80)


SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS s FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS k FROM sh GROUP BY doc_id
), link AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.both >= 80 * (na.k + nb.k - p.both)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
