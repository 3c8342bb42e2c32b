"""Correlation, shrinkage, distances, resampling and preference models. Only k x k tables (k measures) reach the driver or numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliometry.functions.scalar import band_loss, corr, r6, robust_z
from foliometry.operators import evaluation, sampling
from foliometry.operators.lineage import cut
from foliometry.operators.quantiles import joined, percentiles, ranked


def _pairs(dims: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(dims) for b in dims[i + 1 :]]


def spearman(wide: DataFrame, keys: list[str], dims: list[str], least: int) -> DataFrame:
    """(keys, a, b, n, rho) of every two measures; groups below `least` rows are left out. Ranks are taken once a measure."""
    table = cut(wide.dropna(subset=dims).select(*keys, *dims))
    for d in dims:
        table = ranked(table, keys, d, f"r_{d}").drop(d)
    pairs = _pairs(dims)
    g = table.groupBy(*keys).agg(F.count("*").alias("n"), *[corr(f"r_{a}", f"r_{b}").alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{k}").alias("rho")) for k, (a, b) in enumerate(pairs)])
    return g.where(F.col("n") >= least).select(*keys, "n", F.explode(rows).alias("r")).select(*keys, "r.a", "r.b", "n", "r.rho")


def groups(rho: DataFrame, keys: list[str], level: float) -> DataFrame:
    """Connected groups of measures at an absolute correlation of `level` or more."""
    e = rho.where(F.abs("rho") >= level)
    # one row a stratum: the k(k-1)/2 links of k measures; labels settle inside the row, by repeated least neighbour
    links = e.groupBy(*keys).agg(F.collect_list(F.struct("a", "b")).alias("e"))
    names = F.array_distinct(F.flatten(F.transform("e", lambda x: F.array(x["a"], x["b"]))))
    start = links.withColumn("l", F.map_from_entries(F.transform(names, lambda m: F.struct(m.alias("k"), m.alias("v")))))
    rounds = F.sequence(F.lit(1), F.size("l"))

    def step(labels: Column, _: Column) -> Column:
        def near(k: Column, v: Column) -> Column:
            around = F.transform(F.filter("e", lambda x: (x["a"] == k) | (x["b"] == k)), lambda x: F.least(F.element_at(labels, x["a"]), F.element_at(labels, x["b"])))
            return F.least(v, F.array_min(around))

        return F.transform_values(labels, near)

    reach = start.select(*keys, F.explode(F.aggregate(rounds, F.col("l"), step)).alias("a", "b"))
    label = reach.groupBy(*keys, "a").agg(F.min("b").alias("grp"))
    return label.groupBy(*keys, "grp").agg(F.array_join(F.sort_array(F.collect_set("a")), ",").alias("members"))


def wide_z(pages: DataFrame, block: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """Page rows with the clipped z of each measure; complete rows only. The block of a stratum is one row, so no page is shuffled."""
    ends = F.struct(F.col("center").alias("c"), F.col("scale").alias("s"))
    blocks = cut(block.groupBy(*keys).pivot("dim", dims).agg(F.first(ends)).withColumnsRenamed({d: f"__{d}" for d in dims}))
    z = [robust_z(F.col(d).cast("double"), F.col(f"__{d}.c"), F.col(f"__{d}.s")).alias(d) for d in dims]
    # a missing value has no z (the clip would make it one)
    z = [F.when(F.col(d).isNotNull() & F.col(f"__{d}").isNotNull(), c).alias(d) for d, c in zip(dims, z, strict=True)]
    return pages.join(blocks, keys).select("paper", "page", *keys, *z).dropna(subset=dims)


def shrunk_correlation(z: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """(keys, a, b, n, r, delta, shrunk): correlations and how far they are drawn to the identity."""
    pairs = _pairs(dims)
    cols = [c for k, (a, b) in enumerate(pairs) for c in (corr(a, b).alias(f"r{k}"), F.var_samp(F.col(a) * F.col(b)).alias(f"v{k}"))]
    g = z.groupBy(*keys).agg(F.count("*").alias("n"), *cols)
    total = lambda f: sum((f(k) for k in range(1, len(pairs))), f(0))
    delta = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total(lambda k: F.col(f"v{k}")) / F.col("n") / F.nullif(total(lambda k: F.col(f"r{k}") * F.col(f"r{k}")), F.lit(0.0))))
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return g.select(*keys, "n", delta.alias("delta"), F.explode(rows).alias("x")).select(*keys, "x.a", "x.b", "n", "x.r", "delta", ((1 - F.col("delta")) * F.col("x.r")).alias("shrunk"))


def inverses(matrix: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """(key, i, j, v): inverse matrices; a group holds the k(k-1)/2 pairs of one stratum."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        m = np.eye(len(dims))
        for r in rows.itertuples():
            i, j = dims.index(r.a), dims.index(r.b)
            m[i, j] = m[j, i] = r.shrunk
        inv = np.linalg.pinv(m) if np.linalg.cond(m) > 1e12 else np.linalg.inv(m)
        return pd.DataFrame({key: rows[key].iloc[0], "i": np.repeat(dims, len(dims)), "j": dims * len(dims), "v": inv.ravel()})

    return matrix.select(key, "a", "b", "shrunk").groupBy(key).applyInPandas(run, f"{key} string, i string, j string, v double")


def chi2_tail(x: Column, k: int) -> Column:
    """Upper tail of chi-square for an even number of degrees, in closed form."""
    assert k % 2 == 0
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, k // 2):
        term = term * x / (2.0 * i)
        total = total + term
    return F.exp(-x / 2) * total


def binomial_tail(n: Column, hits: Column) -> Column:
    """Probability of at least so many hits in n fair draws, in logs; n is the size of a sheet of human choices, not of a corpus."""
    start = F.aggregate(F.when(n > hits, F.sequence(F.lit(1).cast("long"), n - hits)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, i: s + F.log((hits + i) / i)) - n * F.log(F.lit(2.0))
    more = F.when(n > hits, F.sequence(hits, n - 1)).otherwise(F.array().cast("array<bigint>"))
    step = lambda s, k: F.struct((s["l"] + F.log((n - k) / (k + 1))).alias("l"), (s["p"] + F.exp(s["l"] + F.log((n - k) / (k + 1)))).alias("p"))
    return F.aggregate(more, F.struct(start.alias("l"), F.exp(start).alias("p")), step, lambda s: s["p"])


def mahalanobis(z: DataFrame, inverse: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """d2 and its chi-square tail of each row; the matrix of a stratum is one row (k x k numbers), written, so that it is broadcast to the rows.

    A cell is known by its place, so no row looks it up by a name.
    """
    n = len(dims)
    cells = [F.max(F.when((F.col("i") == a) & (F.col("j") == b), F.col("v"))) for a in dims for b in dims]
    joined = z.join(cut(inverse.groupBy(key).agg(F.array(*cells).alias("m"))), key)
    d2 = sum((F.col(a) * F.col(b) * F.get("m", F.lit(x * n + y)) for x, a in enumerate(dims) for y, b in enumerate(dims)), F.lit(0.0))
    return joined.withColumn("d2", F.greatest(d2, F.lit(0.0))).withColumn("p", chi2_tail(F.col("d2"), n))


def pca(wide: DataFrame, dims: list[str]) -> DataFrame:
    """(component, explained, cumulative) from the k x k correlation matrix, which alone reaches the driver."""
    pairs = _pairs(dims)
    row = wide.dropna(subset=dims).agg(F.count("*").alias("n"), *[corr(a, b).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]).first()
    m = np.eye(len(dims))
    for k, (a, b) in enumerate(pairs):
        m[dims.index(a), dims.index(b)] = m[dims.index(b), dims.index(a)] = row[f"p{k}"]
    share = np.sort(np.linalg.eigvalsh(m))[::-1] / len(dims)
    rows = [(k + 1, round(float(s), 5), round(float(c), 5)) for k, (s, c) in enumerate(zip(share, np.cumsum(share), strict=True))]
    return wide.sparkSession.createDataFrame(rows, "component long, explained double, cumulative double")


def bootstrap_median(long: DataFrame, paper: str, keys: list[str], rounds: int, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the median over resampled papers; null below five papers.

    Only values near the group's median meet the resamples one by one; those below are counts of their paper. Where a
    resample's median is not among the near values the range is widened until it is, so the medians are exact.
    """
    values = cut(long.groupBy(paper, *keys, "value").agg(F.count("*").alias("c")))
    counts = cut(evaluation.bootstrap_counts(cut(values.select(paper).distinct()), paper, rounds))
    middle = percentiles(values, keys, (0.5,), count="c").select(*keys, r6(F.col("p")[0]).alias("p50"))
    n = cut(joined(values.groupBy(*keys).agg(F.count_distinct(paper).alias("papers"), F.sum("c").alias("pages")), middle, keys, "left"))
    reach = min(0.5, 2.5 / (n.agg(F.min("pages")).first()[0] or 1) ** 0.5)
    while True:
        medians, inside = _near_medians(values, counts, paper, keys, reach)
        if inside or reach >= 0.5:
            break
        reach = min(0.5, reach * 3)
    at = lambda q: F.get(F.array_sort(F.collect_list("m")), F.lit(min(rounds - 1, int(rounds * q))))
    ci = medians.groupBy(*keys).agg(at(alpha / 2).alias("lo"), at(1 - alpha / 2).alias("hi"))
    some = F.col("papers") >= 5
    return n.join(ci, keys).select(*keys, "p50", r6(F.when(some, F.col("lo"))).alias("ci_lo"), r6(F.when(some, F.col("hi"))).alias("ci_hi"))


def _near_medians(values: DataFrame, counts: DataFrame, paper: str, keys: list[str], reach: float) -> tuple[DataFrame, bool]:
    """(iter, keys, m): each resample's median, found among values within `reach` of the middle rank; and whether all were there."""
    ends = values.groupBy(*keys).agg(F.percentile_approx("value", F.array(F.lit(max(0.0, 0.5 - reach)), F.lit(min(1.0, 0.5 + reach))), 10_000).alias("e"))
    if reach >= 0.5:
        ends = values.groupBy(*keys).agg(F.array(F.min("value"), F.max("value")).alias("e"))
    placed = values.join(F.broadcast(ends), keys)
    low, near = F.col("value") < F.col("e")[0], (F.col("value") >= F.col("e")[0]) & (F.col("value") <= F.col("e")[1])
    sums = placed.groupBy(paper, *keys).agg(F.sum(F.when(low, F.col("c")).otherwise(0)).alias("low"), F.sum("c").alias("all"))
    base = sums.join(counts, paper).groupBy("iter", *keys).agg(F.sum(F.col("low") * F.col("mult")).alias("low"), F.sum(F.col("all") * F.col("mult")).alias("all"))
    weight = placed.where(near).join(counts, paper).groupBy("iter", *keys, "value").agg(F.sum(F.col("c") * F.col("mult")).alias("k"))
    seen = weight.withColumn("cum", F.sum("k").over(W.partitionBy("iter", *keys).orderBy("value").rowsBetween(W.unboundedPreceding, 0)))
    first = lambda r: F.min(F.when(F.col("low") + F.col("cum") > r, F.col("value")))
    r0, r1 = F.floor((F.col("all") - 1) / 2), F.ceil((F.col("all") - 1) / 2)
    found = base.join(seen, ["iter", *keys], "left").groupBy("iter", *keys).agg(first(r0).alias("m0"), first(r1).alias("m1"), F.max(F.col("low") > r0).alias("under"))
    found = cut(found)
    inside = not found.where("m0 is null or m1 is null or under").take(1)
    return found.select("iter", *keys, ((F.col("m0") + F.col("m1")) / 2).alias("m")), inside


def separability(rows: DataFrame, item: str, label: str, dims: list[str], permutations: int, least: int = 20) -> DataFrame:
    """Accuracy, majority baseline and permutation p over labels of `least` items or more; all null where fewer than two labels remain.

    Neighbours are found once, labels are dealt anew each time. Items are numbered by range over all permutations at once.
    """
    large = rows.groupBy(label).count().where(F.col("count") >= least).select(label)
    rows = cut(rows.join(large, label, "left_semi"))
    near = evaluation.nearest(rows, item, label, dims).select(item, "near_item")
    n, enough = rows.count(), rows.select(label).distinct().count() >= 2
    given = sampling.numbered(rows.select(item, label), [item]).select(item, F.col(label).alias("given"), F.col("__rn").alias("k"))
    given = cut(given)
    mixed = given.select(item, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(permutations).cast("long"))).alias("perm"))
    mixed = mixed.withColumn("o", F.col("perm") * (1 << 40) + F.pmod(F.xxhash64("perm", item), F.lit(1 << 40)))
    target = sampling.numbered(mixed, ["o", item]).select(item, "perm", (F.col("__rn") - (F.col("perm") - 1) * n).alias("k"))
    target = target.unionByName(given.select(item, F.lit(0).cast("long").alias("perm"), "k"))
    dealt = cut(target.join(given.select("k", "given"), "k").select("perm", item, "given"))
    a = dealt.join(near, item)
    b = dealt.select("perm", F.col(item).alias("near_item"), F.col("given").alias("near_given"))
    acc = a.join(b, ["perm", "near_item"]).groupBy("perm").agg((F.count_if(F.col("given") == F.col("near_given")) / n).alias("acc"))
    top = rows.groupBy(label).count().agg((F.max("count") / n).alias("majority"))
    out = acc.withColumn("real", F.max(F.when(F.col("perm") == 0, F.col("acc"))).over(W.partitionBy()))
    p = (1 + F.count_if((F.col("perm") > 0) & (F.col("acc") >= F.col("real")))) / (1 + permutations)
    told = lambda c: F.when(F.lit(enough), r6(c))
    return out.agg(told(F.max("real")).alias("accuracy"), told(p).alias("p_value")).join(top).withColumn("majority", told(F.col("majority")))


def ladder(block: DataFrame) -> DataFrame:
    """Values at half, one, two and four scales from the centre, up and down, not below 0."""
    steps = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(s).cast("long").alias("sign"), F.lit(m).alias("m")) for k, m in ((1, 0.5), (2, 1.0), (3, 2.0), (4, 4.0)) for s in (1, -1)])).alias("s")
    return block.select("role", "dim", "center", "scale", "lo", "hi", steps).select("role", "dim", "s.k", "s.sign", F.greatest(F.lit(0.0), F.col("center") + F.col("s.sign") * F.col("scale") * F.col("s.m")).alias("v"), "lo", "hi", "scale")


def direction(rungs: DataFrame) -> DataFrame:
    loss = rungs.withColumn("loss", band_loss(F.col("v"), F.col("lo"), F.col("hi"), F.col("scale")))
    d = loss.withColumn("d", F.col("loss") - F.lag("loss").over(W.partitionBy("role", "dim", "sign").orderBy("k")))
    g = d.groupBy("role", "dim", "sign").agg((F.min("d") >= -1e-9).cast("int").alias("mono"), F.round(F.max("loss") - F.min("loss"), 6).alias("rise"))
    return g.groupBy("role", "dim").agg(F.max(F.struct("mono", "rise", "sign")).alias("b")).select("role", "dim", "b.sign", (F.col("b.mono") == 1).alias("monotone"))


def preference_weights(pairs: DataFrame, dims: list[str], steps: int = 40, rate: float = 0.5, pull: float = 0.01) -> DataFrame:
    """Logistic weights of preference differences: each step is one aggregate over all pairs; k weights stay on the driver."""
    spread = pairs.agg(*[F.coalesce(F.nullif(F.stddev_pop(d), F.lit(0.0)), F.lit(1.0)).alias(d) for d in dims]).first()
    scaled = pairs.select(*[(F.col(d) / spread[d]).alias(d) for d in dims]).cache()
    w = dict.fromkeys(dims, 0.0)
    for _ in range(steps):
        slope = 1 - 1 / (1 + F.exp(-sum((F.col(d) * w[d] for d in dims), F.lit(0.0))))
        g = scaled.agg(*[F.avg(slope * F.col(d)).alias(d) for d in dims]).first()
        w = {d: w[d] + rate * ((g[d] or 0.0) - pull * w[d]) for d in dims}
    scaled.unpersist()
    return pairs.sparkSession.createDataFrame([(d, round(w[d], 4)) for d in dims], "dim string, weight double")


def strengths(tally: DataFrame, a: str, b: str, wins_a: str, wins_b: str, rounds: int = 2000, prior: float = 0.5) -> DataFrame:
    """Strengths with geometric mean 1 from a win table (one row for each pair of items, which is what reaches the driver)."""
    rows = tally.collect()
    items = sorted({r[a] for r in rows} | {r[b] for r in rows})
    n = len(items)
    w = np.full((n, n), 0.0)
    for r in rows:
        i, j = items.index(r[a]), items.index(r[b])
        w[i, j] += r[wins_a] + prior
        w[j, i] += r[wins_b] + prior
    s = np.ones(n)
    games = w + w.T
    for _ in range(rounds):
        new = w.sum(axis=1) / np.maximum((games / (s[:, None] + s[None, :])).sum(axis=1), 1e-12)
        new /= np.exp(np.log(new).mean())
        done = np.abs(new - s).max() < 1e-12
        s = new
        if done:
            break
    return tally.sparkSession.createDataFrame([(k, round(float(v), 5)) for k, v in zip(items, s, strict=True)], "item string, strength double")
