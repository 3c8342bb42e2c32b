"""Deterministic samples. Global order comes from a range sort with per-partition offsets, never from one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with __rn (0-based place in the order) and __n (number of rows).

    The rows are dealt by range and sorted within partitions; a place is the row's number in its range plus the counts of
    the ranges before. The counts are one row a range.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.select(F.percentile_approx(F.col(order[0]), F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 10_000).alias("c"))
    dealt = df.join(F.broadcast(cuts)).withColumn("__r", F.size(F.filter("c", lambda x: F.col(order[0]) > x))).drop("c")
    sizes = dealt.groupBy("__r").agg(F.count("*").alias("__k"))
    before = sizes.select("__r", F.coalesce(F.sum("__k").over(W.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__k").over(W.partitionBy()).alias("__n"))
    place = F.row_number().over(W.partitionBy("__r").orderBy(*order)) - 1
    return dealt.withColumn("__p", place).join(F.broadcast(before), "__r").withColumn("__rn", F.col("__before") + F.col("__p")).drop("__r", "__p", "__before")


def systematic(df: DataFrame, key: str, limit: int) -> DataFrame:
    """Every n/limit-th row of the ordered table."""
    rows = numbered(df, [key])
    slot = F.ceil(F.col("__rn") * limit / F.col("__n"))
    return rows.where((F.floor(slot * F.col("__n") / limit) == F.col("__rn")) & (slot < limit)).drop("__rn", "__n")


def terciles(df: DataFrame, order: list[str], per_third: int) -> DataFrame:
    """Rows at a stride inside each third of the ordered table, with the third."""
    rows = numbered(df, order)
    size = F.floor(F.col("__n") / 3)
    third = F.when(F.col("__rn") < size, 0).when(F.col("__rn") < 2 * size, 1).otherwise(2)
    stride = F.greatest(F.floor(size / per_third), F.lit(1))
    return rows.withColumn("third", third.cast("long")).where(((F.col("__rn") - F.col("third") * size) % stride) == 0).drop("__rn", "__n")


def scrambled(*cols: str | Column) -> Column:
    """A repeatable order of ids by integer arithmetic, which any SQL engine can redo."""
    out = F.lit(13).cast("long")
    for c, m in zip(cols, (7919, 104729, 1299709), strict=False):
        out = out + (F.col(c) if isinstance(c, str) else c) * m
    return F.pmod(out, F.lit(1000003))


def one_per_group(df: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """One row of each group, by the scrambled order of the ids."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(scrambled(*ids), ids[0]))
    return df.withColumn("__k", first).where("__k = 1").drop("__k")
