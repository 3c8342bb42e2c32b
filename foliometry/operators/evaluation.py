"""Evaluation: neighbours, folds, bootstrap, permutation, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliometry.operators import sampling
from foliometry.operators.lineage import cut

#: A neighbour search starts with cells of about so many items, and widens them so many times for items that it leaves open.
PER_CELL, WIDEN = 2.0, 4.0


def nearest(rows: DataFrame, item: str, label: str, dims: list[str]) -> DataFrame:
    """Each item's nearest other item (root mean square over the dims; ties to the smaller id) and that item's label.

    Items meet those of their own and the neighbouring cells of a grid over the first two dims. What lies beyond is a cell's
    side away at least, so a nearer find is final; items without one meet wider cells in the next round. Items with a missing
    measure are far from all: they, and an item whose others all are such, get the smallest other id.
    """
    rows = cut(rows.select(item, label, *dims))
    whole = rows.dropna(subset=dims)
    axes = dims[:2]
    m = whole.agg(F.count("*").alias("n"), *[f(d).alias(f"{k}{i}") for i, d in enumerate(axes) for k, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_pop))]).first()
    spans = [(m[f"hi{i}"] or 0.0) - (m[f"lo{i}"] or 0.0) for i in range(len(axes))]
    wide = [3.5 * m[f"sd{i}"] for i in range(len(axes)) if m[f"sd{i}"]]
    side = (PER_CELL / m["n"] * reduce(float.__mul__, wide)) ** (1 / len(wide)) if wide else 1.0
    found, left = [], whole
    while m["n"] > 1:
        last = side > max(spans)
        near = cut(_in_cells(left, whole, item, label, dims, axes, side))
        # distances are rounded, so one that meets the bound may tie with an item beyond
        done = near if last else near.where(F.col("m.d") + 1e-8 < side / len(dims) ** 0.5)
        found.append(done)
        if last:
            break
        left = cut(left.join(done.select(item), item, "left_anti"))
        if not left.take(1):
            break
        side *= WIDEN
    least = rows.orderBy(item).limit(2).select(F.lit(None).cast("double").alias("d"), F.col(item).alias("i"), F.col(label).alias("l"))
    met = reduce(DataFrame.unionByName, found) if found else None
    rest = rows if met is None else rows.join(met.select(item), item, "left_anti")
    rest = rest.select(item, label).join(F.broadcast(least), F.col(item) != F.col("i")).groupBy(item, label).agg(F.min_by(F.struct("d", "i", "l"), "i").alias("m"))  # two rows
    best = rest if met is None else met.unionByName(rest)
    return best.select(item, label, F.col("m.i").alias("near_item"), F.col("m.l").alias("near"), F.col("m.d").alias("distance"))


def _in_cells(left: DataFrame, whole: DataFrame, item: str, label: str, dims: list[str], axes: list[str], side: float) -> DataFrame:
    """item, label and m (d, i, l): the nearest other item in the cells around that of the item."""
    at = [F.floor(F.col(d) / side) for d in axes]
    around = [F.explode(F.sequence(c - 1, c + 1)).alias(f"__c{k}") for k, c in enumerate(at)]
    a = left
    for cell in around:
        a = a.select("*", cell)
    a, b = a.alias("a"), whole.select("*", *[c.alias(f"__c{k}") for k, c in enumerate(at)]).alias("b")
    same = reduce(Column.__and__, [F.col(f"a.__c{k}") == F.col(f"b.__c{k}") for k in range(len(axes))])
    distance = F.round(F.sqrt(reduce(Column.__add__, [F.pow(F.col(f"a.{d}") - F.col(f"b.{d}"), 2) for d in dims]) / len(dims)), 9)
    pairs = a.join(b, same & (F.col(f"a.{item}") != F.col(f"b.{item}")))
    return pairs.groupBy(F.col(f"a.{item}").alias(item), F.col(f"a.{label}").alias(label)).agg(F.min(F.struct(distance.alias("d"), F.col(f"b.{item}").alias("i"), F.col(f"b.{label}").alias("l"))).alias("m"))


def folds(papers: DataFrame, paper: str, stratum: str, k: int, seed: int = 17) -> DataFrame:
    """papers with `fold`: k folds dealt within each stratum in a seeded order of ids."""
    mixed = F.pmod(F.col(paper) * 7919 + seed * 104729, F.lit(1000003))
    return papers.withColumn("fold", ((F.row_number().over(W.partitionBy(stratum).orderBy(mixed, paper)) - 1) % k).cast("long"))


def bootstrap_counts(papers: DataFrame, paper: str, rounds: int, seed: int = 23) -> DataFrame:
    """(iter, paper, mult): how often a resample with replacement takes each paper.

    Draws are arithmetic on (round, draw), so any engine can redo them. The table has rounds * papers rows at most, however
    many pages the papers have: pages are weighted by mult and never copied.
    """
    spark = papers.sparkSession
    numbered = sampling.numbered(papers.select(paper), [paper]).select(paper, F.col("__rn").alias("idx"))
    n = numbered.count()
    draws = spark.range(rounds * n).select((F.col("id") / n).cast("long").alias("iter"), (F.col("id") % n).alias("draw"))
    idx = F.pmod((F.col("iter") * 1103515 + F.col("draw") * 12345 + seed) * 7919 % 2147483647 * 48271 % 2147483647, F.lit(n))
    return draws.select("iter", idx.alias("idx")).groupBy("iter", "idx").agg(F.count("*").alias("mult")).join(numbered, "idx").select("iter", paper, "mult")
