"""Near-duplicate vectors by a forest of random-projection trees with spill.

The unit vectors are split again and again at the median of a random projection; vectors close to the split go to both
sides, so near vectors part in a tree only if the split falls between them by more than twice the margin. Many trees make
it unlikely that a close pair parts in all of them. Within a leaf all pairs are compared, in single precision first and in
double precision where that comes near the threshold; links are verified cosines, joined to components.

Fit: the splits of the forest come from a bounded sample (sample_rows and SAMPLE_BYTES, by a hash of the id); every vector is
then sent down every tree. Equal directions fall together first (one representative and a count), so copies of any number cost
one row. A leaf larger than block rows is cut into parts, and each pair of parts is a group of its own (blocks of a matrix
product), so no leaf is collected whole; groups are dealt to tasks by leaf and parts. From a block come, for each vector, the
number of vectors linked there, counted in the first leaf where a pair meets, and a spanning forest of the block's links
instead of all pairs. Vectors travel as the bytes that the table holds (4 or 8 a number).

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
another length link among those of their own length only; rows that share an id are one vector of several directions, with
the largest count of links and the smallest component, and have a row each; a row with a null id links with nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliometry.llm.common import connected_components, mark, materialize, release

SAMPLE_ROWS, SAMPLE_BYTES, TREES, LEAF, BLOCK, MARGIN = 20_000, 64 << 20, 6, 400, 512, 0.012
#: Single precision is off by less than this for unit vectors of any usual length.
SLACK = 1e-4
UNIT = "vec_id long, dims int, h1 long, h2 long, v binary"


class Tree:
    """Splits in heap order: node i has the children 2i + 1 and 2i + 2; a node without a direction is a leaf."""

    def __init__(self, sample: np.ndarray, leaf: float, rng: np.random.Generator, margin: float) -> None:
        self.splits: dict[int, tuple[np.ndarray, float]] = {}
        self.margin = margin
        self._grow(sample, 0, leaf, rng)

    def _grow(self, rows: np.ndarray, node: int, leaf: float, rng: np.random.Generator) -> None:
        if len(rows) <= max(leaf, 8) or node > 1 << 40:
            return
        for _ in range(4):  # a direction that does not spread the rows is tried again, in the span of two of them
            a, b = rows[rng.integers(len(rows), size=2)]
            way = rng.standard_normal(rows.shape[1])
            way = way / np.linalg.norm(way) if _ % 2 == 0 else (a - b) / max(np.linalg.norm(a - b), 1e-12)
            at = rows @ way
            middle = float(np.median(at))
            left, right = at <= middle + self.margin, at >= middle - self.margin
            if max(left.sum(), right.sum()) <= 0.8 * len(rows):
                self.splits[node] = (way, middle)
                self._grow(rows[left], 2 * node + 1, leaf, rng)
                self._grow(rows[right], 2 * node + 2, leaf, rng)
                return

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaf numbers; a row is in several leaves where it is close to splits."""
        rows, nodes, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node not in self.splits or not len(at):
                rows.append(at)
                nodes.append(np.full(len(at), node, np.int64))
                continue
            way, middle = self.splits[node]
            p = x[at] @ way
            todo += [(2 * node + 1, at[p <= middle + self.margin]), (2 * node + 2, at[p >= middle - self.margin])]
        return np.concatenate(rows), np.concatenate(nodes)


def forest(sample: np.ndarray, n: int, trees: int = TREES, leaf: int = LEAF, margin: float = MARGIN) -> list[Tree]:
    rng = np.random.default_rng(10)
    return [Tree(sample, leaf * len(sample) / max(n, 1), rng, margin) for _ in range(trees)]


def units(raw: list[bytes] | pa.Array, dtype: str) -> np.ndarray:
    """Unit vectors, in double precision, of equally long rows of bytes."""
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(dtype: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vec_id, vector) to UNIT rows of the vectors that can link; the hashes are of the direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            ids = batch.column(0).to_pylist()
            offsets = np.asarray(column.offsets).astype(np.int64)
            values = column.values
            flat = np.asarray(values.fill_null(math.nan) if values.null_count else values).astype(dtype)
            out: tuple[list, ...] = ([], [], [], [], [])
            valid = np.asarray(column.is_valid())
            for k, (i, j) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                x = flat[i:j]
                if j > i and valid[k] and ids[k] is not None and np.isfinite(x).all() and x.any():
                    u = units([x.tobytes()], dtype)[0] + 0.0  # no negative zero
                    digest = xxhash.xxh3_128_digest(u.tobytes())
                    h1, h2 = np.frombuffer(digest, np.int64).tolist()
                    for column_, value in zip(out, (ids[k], j - i, h1, h2, x.tobytes()), strict=True):
                        column_.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], names=["vec_id", "dims", "h1", "h2", "v"]
            )

    return run


def _spread(trees: list[Tree], dtype: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (rep, copies, v) with all leaves of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = units(batch.column(2).to_pylist(), dtype)
            rows, leaves = [], []
            for k, tree in enumerate(trees):
                r, node = tree.leaves(x)
                rows.append(r)
                leaves.append(node * len(trees) + k)
            rows, leaves = np.concatenate(rows), np.concatenate(leaves)
            order = np.lexsort((leaves, rows))
            rows, leaves = rows[order], leaves[order]
            counts = np.bincount(rows, minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(leaves))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], names=["rep", "copies", "v", "leaves"])

    return run


def _spanning(left: np.ndarray, right: np.ndarray, n: int) -> list[int]:
    """Positions of the links that first connect what was apart."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for k, (i, j) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(k)
            if len(kept) == n - 1:
                break
    return kept


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have a cosine of at least the threshold, in double precision."""
    near = x.astype(np.float32) @ y.astype(np.float32).T
    link = near >= threshold - SLACK
    p, q = np.nonzero(link & (near < threshold + SLACK))
    for k in range(0, len(p), 65_536):
        i, j = p[k : k + 65_536], q[k : k + 65_536]
        link[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return link


def _compare(threshold: float, dtype: str) -> Callable[[pa.Table], pa.Table]:
    """A pair of parts of a leaf: how many vectors link here first (b -1), and spanning links (n 0)."""

    def run(rows: pa.Table) -> pa.Table:
        leaf, i, j = (rows[c][0].as_py() for c in ("leaf", "i", "j"))
        part, rep, copies = (np.asarray(rows[c]) for c in ("part", "rep", "copies"))
        x = units(rows["v"].to_pylist(), dtype)
        a, b = np.flatnonzero(part == i), np.flatnonzero(part == j)
        link = _linked(x[a], x[b], threshold)
        if i == j:
            np.fill_diagonal(link, False)
        # only rows with links need the leaves before this one: a pair that shares one has met there
        own, other = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
        a, b, link = a[own], b[other], link[np.ix_(own, other)]
        leaves = rows["leaves"].combine_chunks()
        leaves = leaves.chunk(0) if isinstance(leaves, pa.ChunkedArray) else leaves
        offsets = np.asarray(leaves.offsets).astype(np.int64)
        flat, owner = np.asarray(leaves.flatten()), np.repeat(np.arange(len(x)), np.diff(offsets))
        some = (flat < leaf) & np.isin(owner, np.concatenate([a, b]))
        before, at = np.unique(flat[some], return_inverse=True)
        new = link
        if len(before) and len(a):
            met = np.zeros((len(x), len(before)), np.float32)
            met[owner[some], at] = 1
            new = link & (met[a] @ met[b].T == 0)
        count = np.zeros(len(x), np.int64)
        count[a] += new @ copies[b]
        if i != j:
            count[b] += copies[a] @ new
        p, q = np.nonzero(np.triu(link) if i == j else link)
        kept = _spanning(a[p], b[q], len(x))
        p, q = a[p[kept]], b[q[kept]]
        some = np.flatnonzero(count)
        return pa.table({
            "a": np.concatenate([rep[some], rep[p]]), "b": np.concatenate([np.full(len(some), -1), rep[q]]).astype(np.int64),
            "is_link": np.concatenate([np.zeros(len(some), bool), np.ones(len(p), bool)]), "n": np.concatenate([count[some], np.zeros(len(p), np.int64)]),
        })

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, margin: float = MARGIN, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark, since = vectors.sparkSession, mark()
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    dtype = "<f4" if single else "<f8"
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    unit = materialize(own.mapInArrow(_usable(dtype), UNIT), "unit")
    direction = ["dims", "h1", "h2"]
    groups = materialize(unit.groupBy(*direction).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "groups")
    members = unit.drop("v").join(groups, direction).select("vec_id", "rep", "copies")
    # a representative is known by id and direction, as rows may share an id
    reps = unit.join(groups.withColumnRenamed("rep", "vec_id"), [*direction, "vec_id"]).dropDuplicates([*direction, "vec_id"])
    reps = materialize(reps.select(F.col("vec_id").alias("rep"), "copies", "v", "dims"), "reps")
    schema = "a long, b long, is_link boolean, n long"
    found = spark.createDataFrame([], schema)
    for row in reps.groupBy("dims").count().orderBy("dims").collect():  # one row for each vector length
        own, n = reps.where(F.col("dims") == row["dims"]), row["count"]
        most = max(2, min(sample_rows, SAMPLE_BYTES // (8 * row["dims"])))
        sample = own.where(F.pmod(F.xxhash64(F.lit(5), "rep"), F.lit(1_000_000)) < math.ceil(1e6 * most / n)).select("v").limit(2 * most).collect()
        trees_ = forest(units([bytes(r["v"]) for r in sample], dtype), n, trees, leaf, margin)
        spread = materialize(own.select("rep", "copies", "v").mapInArrow(_spread(trees_, dtype), "rep long, copies long, v binary, leaves array<long>"), "spread")
        each = spread.select("*", F.explode("leaves").alias("leaf"))
        sizes = spread.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
        sized = each.join(materialize(sizes, "sizes"), "leaf").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("k")).cast("int"))
        dealt = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
        # dealt to tasks by all three: by leaf alone, all blocks of a large leaf would be one task's
        dealt = dealt.select("rep", "copies", "v", "leaves", "leaf", "part", "i", "j").repartition("leaf", "i", "j")
        found = found.union(dealt.groupBy("leaf", "i", "j").applyInArrow(_compare(threshold, dtype), schema))
    found = materialize(found, "found")
    counts = found.where("not is_link").groupBy("a").agg(F.sum("n").alias("n"))
    labels = connected_components(found.where("is_link").select("a", "b"))
    linked = members.join(counts, members["rep"] == counts["a"], "left").join(labels, members["rep"] == labels["node"], "left")
    linked = linked.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = materialize(linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "linked")
    release(spark, since, linked)
    everyone = vectors.select(F.col(vec_id).cast("long").alias("vec_id")).join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return everyone.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings)


SQL = r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.95
), reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
"""
