"""Ordered scans: ranks, runs, state, as-of values, crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliometry.functions.scalar import r6


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, numbered from 1. Spark keeps k rows a group before the shuffle."""
    return df.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("k") <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1).drop("k")


def average_rank(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """Ranks from 1, equal values share their mean rank. Equal values are counted before the window."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    ranks = counts.withColumn(out, upto - (F.col("__c") - 1) / 2).drop("__c")
    return df.join(ranks, [*keys, value])


def runs(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Maximal runs of neighbouring rows where flag holds: first, last, length."""
    w = W.partitionBy(*keys).orderBy(order)
    numbered = df.withColumn("__n", F.row_number().over(w)).where(flag)
    islands = numbered.withColumn("__island", F.col("__n") - F.row_number().over(w))
    return islands.groupBy(*keys, "__island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("__island")


def longest_run(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """The longest run of each group; of equally long ones the first."""
    best = F.min(F.struct((-F.col("length")).alias("m"), "first", "last")).alias("b")
    return runs(df, keys, order, flag).groupBy(*keys).agg(best).select(*keys, F.col("b.first").alias("first"), F.col("b.last").alias("last"), (-F.col("b.m")).alias("length"))


def last_marker(df: DataFrame, keys: list[str], order: str, marker: Column, out: str) -> DataFrame:
    """The latest non-null marker up to each row."""
    return df.withColumn(out, F.last(marker, ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def as_of(items: DataFrame, anchors: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each item's value from the last anchor at or before it; null before the first. One window over both, no range join."""
    cols = [c for c in items.columns if c not in (key, at)]
    left = items.select(key, at, *cols, F.lit(None).cast(anchors.schema[value].dataType).alias("__v"), F.lit(1).alias("__item"))
    right = anchors.select(key, at, *[F.lit(None).cast(items.schema[c].dataType).alias(c) for c in cols], F.col(value).alias("__v"), F.lit(0).alias("__item"))
    w = W.partitionBy(key).orderBy(at, "__item").rowsBetween(W.unboundedPreceding, 0)
    return left.unionByName(right).withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__item = 1").drop("__v", "__item")


def monotone(df: DataFrame, keys: list[str], order: str, value: str, tol: float = 1e-4) -> DataFrame:
    """Whether a series never falls (within a relative tolerance) and rises at all; strict rises; worst fall."""
    w = W.partitionBy(*keys).orderBy(order)
    prev = F.lag(value).over(w)
    rows = df.withColumn("__p", prev).withColumn("__d", F.col(value) - F.col("__p")).withColumn("__bad", F.col("__d") < -tol * F.greatest(F.abs("__p"), F.lit(1e-9)))
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("__bad").alias("falls"), F.count_if(F.col("__d") > 0).alias("strict"), r6(F.coalesce(F.min("__d"), F.lit(0.0))).alias("worst"),
        (F.max_by(value, order) - F.min_by(value, order)).alias("rise"),
    )
    return g.select(*keys, "n", "falls", "strict", "worst", ((F.col("falls") == 0) & (F.col("rise") > 1e-9)).alias("ok"))


def step_deltas(df: DataFrame, key: str, order: str, accepted: str, values: list[str]) -> DataFrame:
    """Each step's change against the last accepted step before it (the first row seeds the base)."""
    w = W.partitionBy(key).orderBy(order)
    seeded = df.withColumn("__s", F.when(F.col(accepted) | (F.row_number().over(w) == 1), F.struct(*values)))
    with_base = seeded.withColumn("__b", F.last("__s", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    return with_base.where("__b is not null").select(*df.columns, *[r6(F.col(v) - F.col(f"__b.{v}")).alias(f"d_{v}") for v in values])


def crossing(df: DataFrame, key: str, cost: str, share: str, level: float = 0.5) -> DataFrame:
    """The first cost where the share falls to the level, interpolated from the point before; else the last cost."""
    w = W.partitionBy(key).orderBy(cost)
    rows = df.select(key, cost, share, F.lag(cost).over(w).alias("c0"), F.lag(share).over(w).alias("b0"))
    at = F.when(F.col("b0").isNull() | (F.col("b0") == F.col(share)), F.col(cost)).otherwise(F.col("c0") + (F.col("b0") - level) / (F.col("b0") - F.col(share)) * (F.col(cost) - F.col("c0")))
    hit = F.col(share) <= level
    return rows.groupBy(key).agg(r6(F.coalesce(F.min_by(F.when(hit, at), F.when(hit, F.col(cost))), F.max(cost))).alias("point"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("crossed"))


def over_coverage(df: DataFrame, keys: list[str], x0: str, x1: str) -> DataFrame:
    """How many intervals cover each stretch between neighbouring end points (sweep by +1 and -1 events)."""
    events = df.select(*keys, F.explode(F.array(F.struct(F.col(x0).alias("x"), F.lit(1).alias("d")), F.struct(F.col(x1).alias("x"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.x", "e.d")
    net = events.groupBy(*keys, "x").agg(F.sum("d").alias("d"))
    w = W.partitionBy(*keys).orderBy("x")
    return net.select(*keys, F.col("x").alias("from"), F.lead("x").over(w).alias("to"), F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("cover")).where("to is not null")
