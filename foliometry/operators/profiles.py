"""Reference profiles: quantiles by stratum, bands, losses, and scores of papers against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliometry.functions.scalar import band_loss, confidence_tier, nearest6, r6
from foliometry.operators.aggregates import top_share
from foliometry.operators.lineage import cut
from foliometry.operators.quantiles import Parts, joined, percentiles, wide_percentiles

BAND_QS = (0.1, 0.25, 0.5, 0.75, 0.9)
LEVELS = {"venue_role": ["venue", "role"], "role": ["role"], "venue": ["venue"]}


def profile_levels(long: DataFrame) -> DataFrame:
    """One row for each level, stratum and dim: quantiles, numbers of papers and pages, tier. Papers without a venue count for roles only.

    Rows, papers and sums are counted once by venue and role; those of a level add up those of its parts.
    """
    base, keys = ["venue", "role", "dim"], ["level", "venue", "role", "dim"]

    def deal(parts: DataFrame) -> DataFrame:
        null = F.lit(None).cast("string")
        at = [F.when(F.lit("venue" not in own) | F.col("venue").isNotNull(), F.struct(F.lit(level).alias("level"), *[(F.col(k) if k in own else null).alias(k) for k in ("venue", "role")])) for level, own in LEVELS.items()]
        rest = [c for c in parts.columns if c not in base]
        return parts.withColumn("__s", F.explode(F.array_compact(F.array(*at)))).select("__s.level", "__s.venue", "__s.role", "dim", *rest)

    rows = long.select("paper", F.col("venue").cast("string").alias("venue"), "role", "dim", "value")
    papers = cut(rows.groupBy("paper", *base).agg(F.sum("value").alias("s"), F.count("value").alias("c")))
    g = deal(papers).groupBy(*keys).agg((F.sum("s") / F.sum("c")).alias("mean"), F.count_distinct("paper").alias("n_papers"))
    g = joined(g, percentiles(rows, keys, (0.1, 0.25, 0.5, 0.75, 0.9), parts=Parts(keys, base, ["dim"], deal)), keys)
    names = [nearest6(F.col("p")[i]).alias(c) for i, c in enumerate(("p10", "p25", "p50", "p75", "p90"))]
    return g.select("level", F.concat_ws("|", "venue", "role").alias("key"), "dim", "n", "n_papers", F.round("mean", 7).alias("mean"), *names, confidence_tier(F.col("n_papers")).alias("tier"))


def robust_block(long: DataFrame, keys: list[str], low_dims: tuple[str, ...] = ()) -> DataFrame:
    """Center, scale and band of each dim: IQR (else the wide range, else a floor), the wide band where the IQR is thin."""
    return _bands(percentiles(long, [*keys, "dim"], BAND_QS), keys, low_dims)


def wide_block(pages: DataFrame, keys: list[str], dims: list[str], low_dims: tuple[str, ...] = ()) -> DataFrame:
    """robust_block() of wide rows: no row is copied by measure."""
    return _bands(wide_percentiles(pages, keys, dims, BAND_QS), keys, low_dims)


def _bands(q: DataFrame, keys: list[str], low_dims: tuple[str, ...]) -> DataFrame:
    p10, p25, p50, p75, p90 = (F.col("p")[i] for i in range(5))
    iqr, wide = p75 - p25, p90 - p10
    scale = F.when(iqr > 1e-9, iqr).when(wide > 1e-9, wide / 2.563).otherwise(F.lit(1e-6))
    thin = iqr < 0.1 * wide
    return q.select(*keys, "dim", "n", p50.alias("center"), scale.alias("scale"), F.when(thin, p10).otherwise(p25).alias("lo"), F.when(thin, p90).otherwise(p75).alias("hi"), F.col("dim").isin(*low_dims).alias("low_only") if low_dims else F.lit(False).alias("low_only"))


def page_losses(long: DataFrame, block: DataFrame, keys: list[str]) -> DataFrame:
    """Out-of-band loss of each page and dim, and the loss over its P90 in the stratum, capped at 20.

    The block has a row for each stratum and dim; Spark broadcasts it where its size allows.
    """
    joined = long.join(block.select(*keys, "dim", "scale", "lo", "hi", "low_only"), [*keys, "dim"])
    return joined.withColumn("loss", band_loss(F.col("value"), F.col("lo"), F.col("hi"), F.col("scale"), F.col("low_only")))


def normalise(losses: DataFrame, keys: list[str], cap: float = 20.0) -> DataFrame:
    ref = percentiles(losses, [*keys, "dim"], (0.9,), "loss").select(*keys, "dim", F.col("p")[0].alias("ref"))
    return losses.join(ref, [*keys, "dim"]).withColumn("norm", F.least(F.col("loss") / F.greatest("ref", F.lit(1e-6)), F.lit(cap)))


def wide_norms(pages: DataFrame, long: DataFrame, ids: list[str], keys: list[str], dims: list[str], cap: float = 20.0) -> DataFrame:
    """ids and the normalised loss of each measure, one row a page: the bands of a stratum are one row, so no page is copied or shuffled."""
    block = robust_block(long, keys)
    ref = percentiles(page_losses(long, block, keys), [*keys, "dim"], (0.9,), "loss").select(*keys, "dim", F.col("p")[0].alias("ref"))
    bands = joined(block, ref, [*keys, "dim"]).groupBy(*keys).pivot("dim", dims).agg(F.first(F.struct("scale", "lo", "hi", "low_only", "ref")))
    bands = cut(bands.withColumnsRenamed({d: f"__{d}" for d in dims}))

    def norm(d: str) -> Column:
        at = lambda c: F.col(f"__{d}")[c]
        loss = band_loss(F.col(d).cast("double"), at("lo"), at("hi"), at("scale"), at("low_only"))
        return F.when(F.col(d).isNotNull() & F.col(f"__{d}").isNotNull(), F.least(loss / F.greatest(at("ref"), F.lit(1e-6)), F.lit(cap)))

    return pages.join(F.broadcast(bands), keys).select(*ids, *[norm(d).alias(d) for d in dims])


def pooled_lists(dims: list[str], share: float = 0.05) -> tuple[list[Column], dict[str, Column]]:
    """pooled() of several measures at once, for groups such as the pages of a paper: aggregates of a group, and each measure's value from them."""
    lists = [F.sort_array(F.collect_list(d), asc=False).alias(f"__{d}") for d in dims]

    def value(d: str) -> Column:
        n, add = F.size(f"__{d}"), lambda a, x: a + x
        k = F.greatest(F.lit(1), F.bround(share * n)).cast("int")
        top = F.aggregate(F.slice(f"__{d}", F.lit(1), k), F.lit(0.0), add) / k
        return F.when(n > 0, 0.5 * top + 0.5 * F.aggregate(f"__{d}", F.lit(0.0), add) / n)

    return lists, {d: value(d) for d in dims}


def pooled(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Half the mean of the worst 5 % plus half the mean."""
    return top_share(df, keys, value).withColumn("pooled", 0.5 * F.col("top_mean") + 0.5 * F.col("mean"))


def weighted_score(df: DataFrame, keys: list[str], value: str, weights: dict[str, float]) -> DataFrame:
    """Weighted mean over the dims that are there, summed in their order, so that equal papers have equal scores."""
    w = F.lit(1.0)
    for dim, x in weights.items():
        w = F.when(F.col("dim") == dim, F.lit(x)).otherwise(w)
    part = F.when(F.col(value).isNotNull(), F.struct("dim", w.alias("w"), F.col(value).cast("double").alias("v")))
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("__d"))  # one entry a measure
    total = lambda f: F.aggregate("__d", F.lit(0.0), lambda a, x: a + f(x))
    score = F.try_divide(total(lambda x: x["w"] * x["v"]), total(lambda x: x["w"]))
    return rows.select(*keys, F.size("__d").cast("long").alias("n_dims"), score.alias("score"))


def paper_scores(long: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """Pages to papers: bands, losses, pooled losses of each dim, weighted score."""
    block = robust_block(long, keys)
    losses = normalise(page_losses(long, block, keys), keys)
    return weighted_score(pooled(losses, ["paper", "dim"], "norm"), ["paper"], "pooled", weights)


def rollup(pages: DataFrame, dims: list[str]) -> DataFrame:
    """Median, mean, max, p90 and n of each paper's measures, overall (role 'all') and by role.

    Pages are dealt by paper once, as wide rows; a paper's values are lists by role, and those of all roles are made of them there.
    """
    dealt = pages.select("paper", "role", *[F.col(d).cast("double").alias(d) for d in dims]).repartition("paper")
    own = dealt.groupBy("paper", "role").agg(*[F.struct(F.collect_list(d).alias("v"), F.sum(d).alias("s")).alias(d) for d in dims])
    both = own.groupBy("paper").agg(F.collect_list(F.struct(F.lit(False).alias("all"), "role", *dims)).alias("o"))
    whole = [F.struct(F.flatten(F.col(f"o.{d}.v")).alias("v"), F.aggregate(f"o.{d}.s", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("s")).alias(d) for d in dims]
    every = F.concat("o", F.array(F.struct(F.lit(True).alias("all"), F.lit("all").alias("role"), *whole)))
    rows = both.select("paper", F.explode(every).alias("o")).select("paper", "o.role", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.sort_array(f"o.{d}.v").alias("v"), F.col(f"o.{d}.s").alias("s")) for d in dims])).alias("e"))
    rows = rows.select("paper", "role", "e.dim", F.size("e.v").cast("long").alias("n"), "e.v", "e.s").where("n > 0")

    def at(q: float) -> Column:
        place = q * (F.col("n") - 1)
        a, b, part = F.get("v", F.floor(place).cast("int")), F.get("v", F.ceil(place).cast("int")), place - F.floor(place)
        return r6(F.when(a == b, a).otherwise(a * (1 - part) + b * part))

    return rows.select("paper", "role", "dim", "n", at(0.5).alias("median"), F.round(F.col("s") / F.col("n"), 9).alias("mean"), r6(F.get("v", (F.col("n") - 1).cast("int"))).alias("max"), at(0.9).alias("p90"))
