"""Which measures a stratum is judged by: missing-value patterns, validity, principal components, an ordered choice.

Pages are read once for counts of their missing-value patterns; what follows works on those counts, a few rows a stratum.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliometry.functions.scalar import corr, r6
from foliometry.operators.lineage import cut
from foliometry.operators.quantiles import percentiles

#: The share of the most frequent value at which a measure is no use, and the least spread.
MOST_MODE, LEAST_WIDTH = 0.5, 1e-9


def _bit(i: int) -> Column:
    return F.lit(1 << i)


def patterns(wide: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """Pages of each stratum by which measures are missing (bit i: dims[i]): keys, missing, n. At most 62 measures."""
    mask = reduce(Column.__add__, [F.when(F.col(d).isNull(), _bit(i)).otherwise(F.lit(0)).cast("long") for i, d in enumerate(dims)])
    return wide.groupBy(*keys, mask.alias("missing")).agg(F.count("*").alias("n"))


def complete_dims(counts: DataFrame, keys: list[str], dims: list[str], least_pages: int) -> DataFrame:
    """The measures of each stratum that leave least_pages complete pages: keys, dims (in order), complete.

    The most-missing measure goes first (the first of several), until enough pages are complete or one measure is left. Strata
    that then have fewer than 5 pages, or than a quarter of least_pages, have no row. From counts of patterns alone.
    """
    lost = [F.sum(F.when(F.col("missing").bitwiseAND(_bit(i)) != 0, F.col("n")).otherwise(0)).alias(f"m{i}") for i in range(len(dims))]
    order = F.array_sort(F.array(*[F.struct((-F.col(f"m{i}")).alias("m"), F.lit(i).alias("i")) for i in range(len(dims))]))
    going = counts.groupBy(*keys).agg(*lost).select(*keys, F.transform(order, lambda x: x["i"]).alias("going"))
    steps = going.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(dims) - 1)), lambda k: F.slice("going", k + 1, len(dims)))).alias("dropped", "held"))
    held = F.aggregate("held", F.lit(0).cast("long"), lambda a, i: a + F.expr("1L").cast("long") * F.pow(F.lit(2), i).cast("long"))
    tried = steps.withColumn("bits", held).join(counts, keys)
    sums = tried.groupBy(*keys, "dropped", "held").agg(F.sum(F.when(F.col("missing").bitwiseAND(F.col("bits")) == 0, F.col("n")).otherwise(0)).alias("complete"))
    enough = (F.col("complete") >= least_pages) | (F.col("dropped") == len(dims) - 1)
    first = sums.where(enough).groupBy(*keys).agg(F.min(F.struct("dropped", "held", "complete")).alias("b"))
    names = F.transform(F.array_sort("b.held"), lambda i: F.get(F.array(*map(F.lit, dims)), i))
    return first.where(F.col("b.complete") >= max(5, least_pages // 4)).select(*keys, names.alias("dims"), F.col("b.complete").alias("complete"))


def validity(wide: DataFrame, keys: list[str], dims: list[str], least_pages: int, heavy: tuple[str, ...] = ()) -> DataFrame:
    """Each kept measure of each stratum: complete, n, mode_share, width (P90 less P10, heavy-tailed ones in logs) and note: null if valid.

    Zero-inflated and constant measures are not valid; so are those whose middle has no width.
    """
    pages = cut(wide.select(*keys, *dims))
    kept = complete_dims(cut(patterns(pages, keys, dims)), keys, dims, least_pages)
    kept = cut(kept.select(*keys, "complete", F.explode("dims").alias("dim")))
    values = pages.unpivot(keys, dims, "dim", "value").where("value is not null").groupBy(*keys, "dim", "value").agg(F.count("*").alias("c"))
    values = cut(values.join(kept.select(*keys, "dim"), [*keys, "dim"], "left_semi"))
    shown = F.when(F.col("dim").isin(*heavy) & (F.col("value") > -1), F.log1p("value")).otherwise(F.col("value"))
    wide_ = percentiles(values.withColumn("value", shown), [*keys, "dim"], (0.1, 0.9), count="c").select(*keys, "dim", (F.col("p")[1] - F.col("p")[0]).alias("width"))
    modes = values.groupBy(*keys, "dim").agg(F.sum("c").alias("n"), (F.max("c") / F.sum("c")).alias("mode_share"))
    out = kept.join(modes, [*keys, "dim"]).join(wide_, [*keys, "dim"])
    note = F.when(F.col("mode_share") >= MOST_MODE, "mode").when(F.col("width") <= LEAST_WIDTH, "constant")
    return out.select(*keys, "dim", "complete", "n", r6("mode_share").alias("mode_share"), r6("width").alias("width"), note.alias("note"))


def components(wide: DataFrame, dims: list[str], most: int = 8, least_pages: int = 20) -> DataFrame:
    """Principal components of the standardised complete pages: n, pc, explained, cumulative, k_for_90, rank, dim, loading, error.

    Only the correlation matrix reaches the driver. The six largest loadings of a component are listed; a component's sign
    makes its largest loading positive (the first of equally large ones). With fewer than least_pages complete pages, or
    fewer than two measures, there is one row with an error. Constant measures have no correlation.
    """
    spark = wide.sparkSession
    schema = "n long, pc long, explained double, cumulative double, k_for_90 long, rank long, dim string, loading double, error string"
    pairs = [(i, j) for i in range(len(dims)) for j in range(i)]
    row = wide.dropna(subset=dims).agg(F.count("*").alias("n"), *[corr(dims[i], dims[j]).alias(f"p{i}_{j}") for i, j in pairs], *[F.stddev_pop(d).alias(f"s{i}") for i, d in enumerate(dims)]).first()
    if row["n"] < least_pages or len(dims) < 2:
        return spark.createDataFrame([(row["n"], *[None] * 7, "too few pages or measures")], schema)
    m = np.diag([1.0 if row[f"s{i}"] else 0.0 for i in range(len(dims))])
    for i, j in pairs:
        m[i, j] = m[j, i] = row[f"p{i}_{j}"] or 0.0
    values, vectors = np.linalg.eigh(m)
    values, vectors = values[::-1], vectors[:, ::-1]
    share = values / (values[values > 0].sum() or 1.0)
    reached = [round(float(c), 4) for c in np.cumsum(share)[:most]]
    k90 = next((k + 1 for k, c in enumerate(reached) if c >= 0.9), None)
    rows = []
    for k in range(min(most, len(dims))):
        v = vectors[:, k]
        v = v * np.sign(v[int(np.argmax(np.round(np.abs(v), 9)))])
        for r, i in enumerate(sorted(range(len(dims)), key=lambda i: (-round(abs(v[i]), 9), i))[:6]):
            rows.append((row["n"], k + 1, round(float(share[k]), 4), reached[k], k90, r + 1, dims[i], round(float(v[i]), 3) + 0.0, None))
    return spark.createDataFrame(rows, schema)


def chosen(coverage: DataFrame, keys: list[str], preferred: list[str], metric_group: dict[str, str], least_coverage: float = 0.5, per_group: int = 2, most: int = 8) -> DataFrame:
    """The measures of each stratum in the order in which they are taken: keys, rank, dim.

    coverage: keys, dim, coverage and family (the redundancy group, null for none). Preferred measures go first, in their order,
    then the others by coverage (by name where equal). One is taken of each family, per_group of each metric group, and most in
    all; those covered too little are left out. The choice depends on its order, so it is a fold over one sorted array a stratum.
    """
    place = F.lit(len(preferred))
    for i, d in enumerate(preferred):
        place = F.when(F.col("dim") == d, i).otherwise(place)
    group = F.col("dim")
    for d, g in metric_group.items():
        group = F.when(F.col("dim") == d, g).otherwise(group)
    ranked = F.struct(place.alias("place"), F.when(place < len(preferred), 0.0).otherwise(-F.col("coverage")).alias("less"), "dim", F.coalesce("family", F.concat(F.lit("alone:"), "dim")).alias("family"), group.alias("grp"))
    rows = coverage.where(F.col("coverage") >= least_coverage).groupBy(*keys).agg(F.array_sort(F.collect_list(ranked)).alias("c"))
    start = F.array().cast("array<struct<dim:string,family:string,grp:string>>")

    def take(taken: Column, x: Column) -> Column:
        free = ~F.exists(taken, lambda y: y["family"] == x["family"]) & (F.size(F.filter(taken, lambda y: y["grp"] == x["grp"])) < per_group)
        room = (x["place"] < len(preferred)) | (F.size(taken) < most)
        return F.when(free & room, F.concat(taken, F.array(F.struct(x["dim"].alias("dim"), x["family"].alias("family"), x["grp"].alias("grp"))))).otherwise(taken)

    picked = F.transform(F.slice(F.aggregate("c", start, take), 1, most), lambda x: x["dim"])
    return rows.select(*keys, F.posexplode(picked).alias("k", "dim")).select(*keys, (F.col("k") + 1).cast("long").alias("rank"), "dim")
