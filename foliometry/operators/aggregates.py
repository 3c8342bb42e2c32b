"""Grouped statistics. Index quantiles count equal values before the shuffle, so a group's rows never meet in one list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliometry.functions.scalar import nearest6, r6
from foliometry.operators.lineage import cut
from foliometry.operators.quantiles import counted, joined, percentiles, running


def quantiles(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, mean, min, max and p10..p90 with linear interpolation, rounded to 6 places; for strata of any size."""
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    out = joined(out, percentiles(df, keys, (0.1, 0.25, 0.5, 0.75, 0.9), value), keys)
    names = ("p10", "p25", "p50", "p75", "p90")
    return out.select(*keys, "n", *[r6(c).alias(c) for c in ("mean", "min", "max")], *[nearest6(F.col("p")[i]).alias(c) for i, c in enumerate(names)])


def at_ranks(df: DataFrame, keys: list[str], ranks: dict[str, Column], value: str = "value") -> DataFrame:
    """For each group the values at the given 0-based ranks; a rank is an expression of n, the group's count.

    For groups such as the pages of a paper, whose distinct values one task sorts; see ranks_of for strata.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    w = W.partitionBy(*keys)
    upto = counted.withColumn("__upto", F.sum("__c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("__c").over(w))
    picks = [F.min(F.when(F.col("__upto") > rank, F.col(value))).alias(name) for name, rank in ranks.items()]
    return upto.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def ranks_of(df: DataFrame, keys: list[str], ranks: dict[str, Column], value: str = "value") -> DataFrame:
    """at_ranks for strata of any size."""
    rows = running(cut(counted(df, keys, value)), keys)
    picks = [F.min(F.when(F.col("upto") > rank, F.col("value"))).alias(name) for name, rank in ranks.items()]
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def floor_rank(q: float) -> Column:
    return F.least(F.col("n") - 1, F.floor(F.col("n") * q))


def round_rank(q: float) -> Column:
    return F.bround(q * (F.col("n") - 1))


def truncated_rank(q: float) -> Column:
    return F.floor(F.col("n") * q)


def upper_median_rank() -> Column:
    return F.floor(F.col("n") / 2)


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value (of equally frequent ones the first as text), its count, n and whether it is the only one."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    best = F.min(F.struct((-F.col("c")).alias("m"), F.col(value).cast("string").alias("s")))
    return counts.groupBy(*keys).agg(best.alias("b"), F.sum("c").alias("n"), F.count("*").alias("kinds")).select(
        *keys, F.col("b.s").alias("mode"), (-F.col("b.m")).alias("mode_count"), "n", (F.col("kinds") == 1).alias("consistent")
    )


def mode_binned(df: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """Mean of the values within tol of the fullest bin's centre; of equally full bins the lowest."""
    binned = df.where(F.col(value).isNotNull()).withColumn("bin", F.bround(F.col(value) / tol).cast("long"))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("c"))
    top = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("m"), "bin")).alias("t")).select(*keys, F.col("t.bin").alias("top"))
    near = binned.join(top, keys).where(F.abs(F.col(value) - F.col("top") * tol) <= tol)
    return near.groupBy(*keys).agg(F.round(F.avg(value), 4).alias("mode_value"), F.count("*").alias("n_near"))


def mode_weighted(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The value with the largest total weight; ties go to the smallest value."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    return sums.groupBy(*keys).agg(F.min(F.struct((-F.col("w")).alias("m"), F.col(value).alias("v"))).alias("t")).select(*keys, F.col("t.v").alias("mode_value"), (-F.col("t.m")).alias("weight"))


def spread(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Population deviation and coefficient of variation; null below two values."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.stddev_pop(value).alias("sd"), F.avg(value).alias("mean"))
    some = F.col("n") >= 2
    return out.select(*keys, "n", r6(F.when(some, F.col("sd"))).alias("std"), r6(F.when(some & (F.col("mean") != 0), F.col("sd") / F.col("mean"))).alias("cv"))


def top_share(df: DataFrame, keys: list[str], value: str = "value", share: float = 0.05) -> DataFrame:
    """n, mean, and the mean of the k largest values, k = max(1, round(share * n)) half-even."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    w = W.partitionBy(*keys).orderBy(F.desc(value))  # both sums share one sort
    k = F.greatest(F.lit(1), F.bround(share * F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    before = F.coalesce(F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    used = F.greatest(F.lit(0), F.least(F.col("__c"), F.col("k") - F.col("before")))
    rows = counted.withColumn("k", k.cast("long")).withColumn("before", before).withColumn("used", used)
    return rows.groupBy(*keys).agg(
        F.sum("__c").alias("n"), F.max("k").alias("k"), (F.sum(F.col(value) * F.col("__c")) / F.sum("__c")).alias("mean"), (F.sum(F.col(value) * F.col("used")) / F.max("k")).alias("top_mean")
    )


def coverage(df: DataFrame, keys: list[str], value: str = "value", eps: float = 1e-12) -> DataFrame:
    """Rows with a value, with a value other than 0, and the share of the latter."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.count_if(F.abs(value) > eps).alias("n_nonzero")).withColumn("share_nonzero", r6(F.try_divide(F.col("n_nonzero").cast("double"), F.col("n"))))


def band_hits(df: DataFrame, bands: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Shares below, inside and above a band (columns lo, hi of a small table with the same keys), which is broadcast: no row is dealt by key."""
    v = F.col(value)
    share = lambda c: r6(F.avg(F.when(c, 1.0).otherwise(0.0)))
    return df.join(F.broadcast(bands), keys).groupBy(*keys).agg(F.count(value).alias("n"), share(v < F.col("lo")).alias("below"), share((v >= F.col("lo")) & (v <= F.col("hi"))).alias("inside"), share(v > F.col("hi")).alias("above"))


def category_shares(df: DataFrame, group: list[str], category: str, count: str) -> DataFrame:
    """Summed counts of a category and its share of the group's total."""
    sums = df.groupBy(*group, category).agg(F.sum(count).cast("long").alias("total"))
    return sums.withColumn("share", r6(F.col("total") / F.sum("total").over(W.partitionBy(*group))))


def rate(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Share of true by group; nulls are left out."""
    return df.where(F.col(flag).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), r6(F.avg(F.col(flag).cast("int"))).alias("rate"))
