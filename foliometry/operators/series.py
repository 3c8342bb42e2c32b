"""Exact quantiles of numbers that a function makes of Arrow batches, for series of any size.

A page gives many numbers (a loss for each measure and level, say), so rows by number are never made: a task counts its numbers by
series and bin, where the bin of a double is its leading bits in order of size; the counts are added and give the bins of the wanted
ranks; a second pass keeps the values in those bins alone, counted by value. Both passes read the rows once, and what is shuffled
are counts.

Series may overlap: numbers are counted by parts (such as a cell of strata), and the counts are dealt to the series of a part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliometry.operators.lineage import cut
from foliometry.operators.quantiles import _between, _upto, running, small

#: Leading bits of a double that are its bin; counts that a task holds.
BITS, HELD = 20, 2_000_000

#: From a batch to the numbers' parts and the numbers.
Make = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]
Batches = Iterator[pa.RecordBatch]


def keys_of(parts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Part and bin as one number; bins are in the order of the values, not-a-number last."""
    bits = (np.where(np.isnan(values), np.nan, values) + 0.0).view(np.int64)
    ordered = np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))).view(np.uint64)
    return (parts.astype(np.int64) << BITS) | (ordered >> np.uint64(64 - BITS)).astype(np.int64)


def _counted(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(columns, counts) with the counts of equal rows added."""
    *columns, counts = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])
    columns, counts = [c[order] for c in columns], counts[order]
    if not len(counts):
        return (*columns, counts)
    new = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    starts = np.flatnonzero(np.concatenate([[True], new]))
    return (*[c[starts] for c in columns], np.add.reduceat(counts, starts))


def _tally(rows: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], names: list[str]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        held, size = [], 0

        def given(found: tuple[np.ndarray, ...]) -> Batches:
            for i in range(0, len(found[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in found], names=names)

        for batch in batches:
            held.append(rows(batch))
            size += len(held[-1][0])
            if size > HELD:
                held = [_counted(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from given(held[0])
                    held, size = [], 0
        if held:
            yield from given(_counted(held))

    return run


def _binned(make: Make) -> Callable[[pa.RecordBatch], tuple[np.ndarray, ...]]:
    def rows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        return np.unique(keys_of(*make(batch)), return_counts=True)

    return rows


def _inside(make: Make, opened: np.ndarray) -> Callable[[pa.RecordBatch], tuple[np.ndarray, ...]]:
    def rows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        parts, values = make(batch)
        keys = keys_of(parts, values)
        hit = opened[np.minimum(np.searchsorted(opened, keys), len(opened) - 1)] == keys
        return keys[hit], values[hit] + 0.0, np.ones(int(hit.sum()), np.int64)

    return rows


def quantiles(df: DataFrame, make: Make, qs: tuple[float, ...], deal: DataFrame | None = None) -> DataFrame:
    """series, n and p, the quantiles with linear interpolation. deal: part and series, a row for each series of a part (else parts are series).

    df is read twice. One row for each series is written; the bins that are open reach the driver, some for each part.
    """

    def dealt(counts: DataFrame, *by: str) -> DataFrame:
        parts = counts.select(F.shiftright("key", BITS).alias("series"), F.col("key").bitwiseAND((1 << BITS) - 1).alias("bin"), *by, "c")
        if deal is not None:
            parts = parts.withColumnRenamed("series", "part").join(F.broadcast(deal), "part").drop("part")
        return parts.groupBy("series", "bin", *by).agg(F.sum("c").alias("c"))

    w = W.partitionBy("series")
    counts = dealt(df.mapInArrow(_tally(_binned(make), ["key", "c"]), "key long, c long").groupBy("key").agg(F.sum("c").alias("c")))
    placed = _upto(counts, ["series"], "bin").withColumn("n", F.sum("c").over(w))
    ranks = [f(q * (F.col("n") - 1)).cast("long") for q in qs for f in (F.floor, F.ceil)]
    wanted = reduce(Column.__or__, [(F.col("upto") > r) & (F.col("upto") - F.col("c") <= r) for r in ranks])
    found = cut(placed.where(wanted).select("series", "bin", "n", (F.col("upto") - F.col("c")).alias("before")))
    parts = found.select(F.col("series").alias("part"), "bin") if deal is None else found.join(F.broadcast(deal), "series").select("part", "bin")
    opened = np.array(sorted(r[0] for r in parts.select(F.shiftleft("part", BITS).bitwiseOR(F.col("bin"))).distinct().collect()), np.int64)
    named = [f"__v{k}" for k in range(len(ranks))]
    if not len(opened):
        return found.select("series", "n", F.array(*[F.lit(None).cast("double") for _ in qs]).alias("p"))
    values = df.mapInArrow(_tally(_inside(make, opened), ["key", "value", "c"]), "key long, value double, c long").groupBy("key", "value").agg(F.sum("c").alias("c"))
    values = cut(dealt(values, "value").join(F.broadcast(found), ["series", "bin"]))
    by = ["series", "bin"]
    places = _upto(values, by, "value") if small(values, by) else running(values.drop("n", "before"), by).drop("n").join(F.broadcast(found), by)
    upto = F.col("before") + F.col("upto")
    picked = places.groupBy("series", "n").agg(*[F.min(F.when(upto > r, F.col("value"))).alias(c) for r, c in zip(ranks, named, strict=True)])
    return cut(picked.select("series", "n", _between(qs, named).alias("p")))
