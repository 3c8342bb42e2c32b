"""Pieces shared by the training-data operators: shared scratch tables, components, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts state it: space and \t \n \v \f \r.
BLANKS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Scratch tables written so far, in order, so that an operator can drop those that its result does not read.
_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir, or else the context's checkpoint folder.

    Where neither is set, a fresh local folder serves if all tasks run in this process; on a cluster that is an error, as
    executors would write where nobody reads.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else getattr(spark, "_foliometry_scratch", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = spark._foliometry_scratch = tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


#: For tables whose rows are megabytes: a row group is closed after some of them. Else a task holds a hundred rows or more as it
#: writes, and all rows of a group at once as it reads.
LARGE_ROWS = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.block.row.count.limit": "4"}


def materialize(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes df as a table in the shared scratch folder and reads it back. options: of the Parquet writer.

    This cuts lineage: a lost executor costs a re-read of Parquet and not a new run of everything before.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/foliometry-{label}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    _written.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._foliometry_path = path
    return table


def mark() -> int:
    """A point to which release() goes back."""
    return len(_written)


def release(spark: SparkSession, since: int, *needed: DataFrame) -> None:
    """Deletes the scratch tables written after the mark, but for the needed ones (frames as materialize() gave them)."""
    kept = {df._foliometry_path for df in needed}
    for path in [p for p in _written[since:] if p not in kept]:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        _written.remove(path)


#: Up to so many ids (8 bytes each) are broadcast; beyond it the rows are shuffled to them.
BROADCAST_IDS = 1_000_000


def without(rows: DataFrame, gone: DataFrame, *keys: Column) -> DataFrame:
    """rows without those whose keys stand in gone (distinct, one column a key). Rows with a null key stay.

    Few keys go to the rows, which then are not shuffled; many are joined by shuffle.
    """
    gone = materialize(gone.toDF(*[f"__gone{k}" for k in range(len(keys))]), "gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    match = reduce(Column.__and__, [key == few[f"__gone{k}"] for k, key in enumerate(keys)])
    return rows.join(few, match, "left_anti")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it as long as df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z alone; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold that the contracts name."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links to (node, component): the smallest node that each linked node can reach.

    Rounds of min-label exchange with pointer jumping; the labels are a table in the shared scratch folder
    after each round, so lineage stays short, and only the count of changed labels reaches the driver.
    Nodes without links have no row. An empty link table gives an empty result.
    """
    spark, since = edges.sparkSession, mark()
    there, back = edges.select("a", "b"), edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = materialize(there.union(back).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    for _ in range(max_rounds):
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(heard, F.col("node") == F.col("a")).select("node", "component", F.least("component", "near").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("component").alias("far"))
        moved = materialize(step.join(jump, "best").select("node", F.least("best", "far").alias("new"), "component"), "labels")
        labels = moved.select("node", F.col("new").alias("component"))
        labels._foliometry_path = moved._foliometry_path
        done = not moved.where("new <> component").take(1)
        release(spark, since, labels, *([] if done else [both]))
        if done:
            return labels
    raise RuntimeError("components did not settle")


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def as_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about most_bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
        part = np.cumsum(sizes, dtype=np.int64) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield batch.slice(i, j - i)


#: Odd multipliers and constants of 64-bit mixing.
BASE = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), base, np.uint64), dtype=np.uint64)])[:n]


BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_power_cache: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power_cache.get("up", ())) < n:
        size = max(n, 1 << 20)
        _power_cache["up"], _power_cache["down"] = powers(size, BASE), powers(size, BASE_INVERSE)
    return _power_cache["up"][:n], _power_cache["down"][:n]


_SCRAMBLE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, *range(9, 14)]] = True


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the blank-separated, A-Z-lower-cased words of each text, and where each text's words begin.

    Works on the UTF-8 bytes of the whole batch at once. The second array has one entry more than there are
    texts; the words of text i are hashes[bounds[i]:bounds[i + 1]]. A null has no words.
    """
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and n else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    up, down = _power(len(data))
    blank = _IS_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inner = ~blank
    first = inner.copy()
    first[1:] &= blank[:-1] | edge[1:-1]
    last = inner.copy()
    last[:-1] &= blank[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SCRAMBLE[_LOWERED[data]] * up, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, offsets)
    return hashes, bounds
