"""Exact quantiles of strata of any size.

A stratum of at most MOST rows is sorted by one task. Larger ones are searched: a pass gives each row its bin among bins of equal
width between the least and the largest value, and counts rows by bin; the bins that hold the wanted ranks are open, and are cut
into bins again in the next pass while one of them holds more than MOST rows. The values of the last open bins are then counted
one by one. A row finds its bin by a hash join with a small table, so it meets one bin a pass however many ranks are wanted. Only
counts of bins and the values of open bins are shuffled, so neither a stratum's rows nor its sort meet anywhere.

Strata may overlap: rows are counted by their parts (such as a fold), and small tables of counts are dealt to the strata that the
parts belong to (such as the training sets without that fold), so no row is copied.

Measures of wide rows are searched together (wide_percentiles): a row finds its stratum once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliometry.operators.flatten import to_long
from foliometry.operators.lineage import cut

#: Rows of a stratum that one task takes; bins of a pass, and bins of all parts together; passes, after which what is left is
#: placed by ranges; strata that are searched together, the small ones too.
MOST, BINS, ALL_BINS, PASSES, TOGETHER = 300_000, 8192, 150_000, 6, 20_000


def _equal(keys: list[str]) -> Column:
    """Whether keys equal those of the other table; columns of this module's own are never null, and join by plain numbers."""
    return reduce(Column.__and__, [F.col(k) == F.col(f"__r_{k}") if k.startswith("__") else F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; right's other columns are added."""
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = _equal(keys)
    return left.join(other, same, how).drop(*[f"__r_{k}" for k in keys])


def counted(df: DataFrame, keys: list[str], value: str, count: str | None = None) -> DataFrame:
    """keys, value and c, the number of rows (or the sum of a count column) with that value; nulls are left out."""
    c = F.sum(count) if count else F.count("*")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(c.alias("c"))


def running(values: DataFrame, keys: list[str]) -> DataFrame:
    """values (as counted() gives them) with n, the stratum's rows, and upto, its rows up to and with the value.

    The values are dealt by range, running counts are taken inside a range, and the counts of the ranges before (a row for each
    range and stratum) are added. The ranges are written, as their bounds come from samples that differ between evaluations.
    """
    ranges = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(values.repartitionByRange(ranges, *keys, "value").withColumn("__range", F.spark_partition_id()))
    w = W.partitionBy(*keys)
    before = F.coalesce(F.sum("__size").over(w.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy(*keys, "__range").agg(F.sum("c").alias("__size")).withColumn("n", F.sum("__size").over(w)).withColumn("__before", before).drop("__size")
    inside = F.sum("c").over(W.partitionBy(*keys, "__range").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    return joined(dealt.withColumn("__inside", inside), sizes, [*keys, "__range"]).withColumn("upto", F.col("__before") + F.col("__inside")).drop("__range", "__before", "__inside")


def small(values: DataFrame, keys: list[str]) -> bool:
    """Whether every stratum's counts fit one task."""
    return (values.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= MOST


def _upto(values: DataFrame, keys: list[str], order: str) -> DataFrame:
    return values.withColumn("upto", F.sum("c").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def _same(df: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of spans, a small table, that share its keys, which may be null."""
    other = spans.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = _equal(keys)
    return df.join(F.broadcast(other), same).drop(*[f"__r_{k}" for k in keys])


def _placed(rows: DataFrame, bins: int) -> DataFrame:
    """rows (with an open bin's number and ends) with __at, the number of their bin within it."""
    width = F.col("__hi") - F.col("__lo")
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("__lo")) / width * bins))).otherwise(F.lit(0))
    return rows.withColumn("__at", F.col("__open") * bins + place.cast("long")).drop("__open", "__lo", "__hi")


def _searched(rows: DataFrame, strata: DataFrame, spans: DataFrame, parts: Parts, ranks: list[Column]) -> DataFrame:
    """keys, n, t (place in ranks) and value: the values at 0-based ranks, which are expressions of n."""
    keys, base, deal = parts.keys, parts.base, parts.deal
    each = F.posexplode(F.array(*[r.cast("long") for r in ranks])).alias("t", "rank")
    targets = cut(strata.select(*keys, "n", each))
    numbered = lambda df, order: df.withColumn("__open", F.row_number().over(W.orderBy(*order)).cast("long") - 1)  # noqa: E731 (small tables)
    opened = cut(numbered(spans, parts.span))
    bins = max(256, min(BINS, ALL_BINS // max(parts.n, 1)))
    inside = _placed(_same(rows, opened.select(*parts.span, "__open", "__lo", "__hi"), parts.span), bins)
    for turn in range(PASSES):
        counts = cut(inside.groupBy(*base, "__at").agg(F.sum("c").alias("c"), F.min("value").alias("__lo"), F.max("value").alias("__hi")))
        within = [*keys, "__open"] if turn else keys
        upto = deal(counts.withColumn("__open", F.floor(F.col("__at") / bins))).groupBy(*within, "__at").agg(F.sum("c").alias("c"))
        found = joined(targets, _upto(upto, within, "__at"), within).where("upto > rank and upto - c <= rank")
        targets = cut(found.select(*keys, "n", "t", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), "__at", "c"))
        ends = counts.groupBy("__at").agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
        # some bins a stratum, of strata that are few
        opened = cut(numbered(targets.groupBy("__at").agg(F.max("c").alias("c")).join(ends, "__at"), ["__at"]))
        inside = inside.join(F.broadcast(opened.select("__at", "__open", "__lo", "__hi")), "__at")
        targets = targets.join(F.broadcast(opened.select("__at", "__open")), "__at").drop("__at", "c")
        if turn == PASSES - 1 or (opened.where("__hi > __lo").agg(F.max("c")).first()[0] or 0) <= MOST:
            break
        inside, bins = _placed(inside.drop("__at"), BINS), BINS
    values = cut(inside.groupBy(*base, "__open", "value").agg(F.sum("c").alias("c")))
    values = deal(values).groupBy(*keys, "__open", "value").agg(F.sum("c").alias("c"))
    values = values if deal is _own else cut(values)
    places = _upto(values, [*keys, "__open"], "value") if small(values, [*keys, "__open"]) else running(values, [*keys, "__open"]).drop("n")
    return joined(targets, places, [*keys, "__open"]).where("upto > rank").groupBy(*keys, "n", "t").agg(F.min("value").alias("value"))


def _own(df: DataFrame) -> DataFrame:
    return df


@dataclass
class Parts:
    """Strata (keys) made of parts (base): deal gives each row of a table with the base columns to the strata of its part; bins are
    common to the rows that share the columns `span`. n is the number of parts."""

    keys: list[str]
    base: list[str]
    span: list[str]
    deal: Callable[[DataFrame], DataFrame] = _own
    n: int = 0


def _split(df: DataFrame, parts: Parts, ranks: list[Column], value: str, count: str | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows (keys, value, c) of strata of at most MOST rows, or None, and the values at the ranks of the others, or None.

    df is read several times: what is dear to make, or differs between evaluations (sums of doubles after a shuffle), is cut first.
    """
    c, keys = F.col(count) if count else F.lit(1), parts.keys
    rows = df.where(F.col(value).isNotNull()).select(*parts.base, F.col(value).cast("double").alias("value"), c.cast("long").alias("c"))
    found = cut(rows.groupBy(*parts.base).agg(F.sum("c").alias("n"), F.count("*").alias("__rows"), F.min("value").alias("__lo"), F.max("value").alias("__hi")))
    strata = found if parts.deal is _own else cut(parts.deal(found).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("__rows").alias("__rows")))
    most, many = strata.agg(F.max("__rows"), F.count("*")).first()
    if (most or 0) <= MOST:
        return parts.deal(rows), None
    if parts.deal is not _own or many <= TOGETHER:
        spans = found.groupBy(*parts.span).agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
        return None, _searched(rows, strata, spans, replace(parts, n=found.count()), ranks)
    large = strata.where(F.col("__rows") > MOST)
    found = _searched(rows, large, large.select(*keys, "__lo", "__hi"), replace(parts, n=large.count()), ranks)
    return joined(rows, F.broadcast(large.select(*keys)), keys, "left_anti"), found


def _between(qs: tuple[float, ...], named: list[str]) -> Column:
    """The quantiles, from columns of the values at the two ranks around each."""

    def one(k: int, q: float) -> Column:
        at, a, b = q * (F.col("n") - 1), F.col(named[2 * k]), F.col(named[2 * k + 1])
        part = at - F.floor(at)
        return F.when(a == b, a).otherwise(a * (1 - part) + b * part)  # the form that SQL engines use

    return F.array(*[one(k, q) for k, q in enumerate(qs)])


def percentiles(df: DataFrame, keys: list[str], qs: tuple[float, ...], value: str = "value", count: str | None = None, parts: Parts | None = None) -> DataFrame:
    """keys, n and p: the quantiles with linear interpolation. parts: how strata that overlap are made of rows."""
    ranks = [f(q * (F.col("n") - 1)) for q in qs for f in (F.floor, F.ceil)]
    rows, found = _split(df, parts or Parts(keys, keys, keys), ranks, value, count)
    named = [f"__v{k}" for k in range(len(ranks))]
    parts = []
    if rows is not None and count is None:
        lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("__all"), F.sum("c").alias("n"))  # MOST values at most
        parts.append(lists.select(*keys, "n", *[F.get("__all", r.cast("int")).alias(c) for r, c in zip(ranks, named, strict=True)]))
    elif rows is not None:
        upto = _upto(rows.groupBy(*keys, "value").agg(F.sum("c").alias("c")), keys, "value").withColumn("n", F.sum("c").over(W.partitionBy(*keys)))
        parts.append(upto.groupBy(*keys, "n").agg(*[F.min(F.when(F.col("upto") > r, F.col("value"))).alias(c) for r, c in zip(ranks, named, strict=True)]))
    if found is not None:
        parts.append(found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("t") == k, F.col("value"))).alias(c) for k, c in enumerate(named)]))
    out = reduce(DataFrame.unionByName, parts).select(*keys, "n", _between(qs, named).alias("p"))
    # written, a table of strata has a known size: joins with rows broadcast it and do not deal the rows by stratum
    return out if found is None else cut(out)


def wide_percentiles(wide: DataFrame, keys: list[str], dims: list[str], qs: tuple[float, ...]) -> DataFrame:
    """keys, dim, n and p of each measure of wide rows, as percentiles() gives them for the long form. wide is read several times.

    Strata and measures are known by one number while they are searched, so a value meets its bin by a number and not by texts.
    """
    rows = wide.select(*keys, *[F.col(d).cast("double").alias(d) for d in dims])
    ends = cut(rows.groupBy(*keys).agg(*[F.struct(F.count(d).alias("n"), F.min(d).alias("lo"), F.max(d).alias("hi")).alias(d) for d in dims]))
    most, strata = ends.agg(F.greatest(F.lit(0), *[F.max(f"{d}.n") for d in dims]), F.count("*")).first()
    if most <= MOST or strata * len(dims) > TOGETHER:
        return percentiles(to_long(rows, keys, dims), [*keys, "dim"], qs)
    number = (F.col("__g") * len(dims) + F.col("k")).alias("__s")
    groups = cut(ends.withColumn("__g", F.row_number().over(W.orderBy(*keys)).cast("long") - 1))
    spans = groups.select(*keys, "__g", F.posexplode(F.array(*dims)).alias("k", "e")).where("e.n > 0")
    spans = cut(spans.select(*keys, number, F.get(F.array(*map(F.lit, dims)), F.col("k")).alias("dim"), "e.n", F.col("e.lo").alias("__lo"), F.col("e.hi").alias("__hi")))
    coded = _same(rows, groups.select(*keys, "__g"), keys).select("__g", F.posexplode(F.array(*dims)).alias("k", "value"))
    coded = coded.where("value is not null").select(number, "value", F.lit(1).cast("long").alias("c"))
    ranks = [f(q * (F.col("n") - 1)) for q in qs for f in (F.floor, F.ceil)]
    named = [f"__v{k}" for k in range(len(ranks))]
    found = _searched(coded, spans, spans.select("__s", "__lo", "__hi"), Parts(["__s"], ["__s"], ["__s"], n=spans.count()), ranks)
    found = found.groupBy("__s").agg(*[F.max(F.when(F.col("t") == k, F.col("value"))).alias(c) for k, c in enumerate(named)])
    return cut(spans.join(found, "__s").select(*keys, "dim", "n", _between(qs, named).alias("p")))


def ranked(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """df with the rank of its value in the stratum, from 1; equal values share their mean rank. For strata of any size."""
    values = cut(counted(df, keys, value))
    places = _upto(values, keys, "value") if small(values, keys) else running(values, keys)
    # written, so that the places of a measure with few values are broadcast
    places = cut(places.select(*keys, F.col("value").alias("__value"), (F.col("upto") - (F.col("c") - 1) / 2).alias(out)))
    return joined(df.withColumn("__value", F.col(value).cast("double")), places, [*keys, "__value"]).drop("__value")
