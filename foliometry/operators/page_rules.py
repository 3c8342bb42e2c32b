"""Rules of page images and their attribution: defects of pages and documents, costs by page and what no page accounts for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliometry.operators.aggregates import top_share
from foliometry.operators.lineage import cut

C = F.col


def page_rules() -> tuple[tuple[str, Column, Column, str], ...]:
    """kind, condition, condition of grave cases, measure (fixed values)."""
    bottom, gap, ink, always = C("bottom_blank"), C("max_gap"), C("ink_ratio"), F.lit(True)
    return (
        ("giant_content", C("band") >= 0.40, always, "band"),
        ("bottom_blank", (bottom >= 0.35) | ((bottom >= 0.25) & (ink > 0.01)), bottom >= 0.35, "bottom_blank"),
        ("mid_gap", (gap >= 0.28) & (C("max_gap_at") > 0.15) & (C("max_gap_at") < 0.85), gap >= 0.50, "max_gap"),
        ("stranded_block", (ink > 0) & (ink <= 0.06) & (C("band") >= 0.05) & (bottom >= 0.30), always, "ink_ratio"),
        ("near_empty", (ink > 0) & (ink <= 0.02), always, "ink_ratio"),
    )


#: What a grave defect of a page image costs; others cost the given share of it.
COSTS, MODERATE = {"stranded_block": 1.2, "near_empty": 0.6}, 0.6


def page_defects(pages: DataFrame) -> DataFrame:
    """doc, page, kind, severity, metric of each rule that a readable page breaks; a null measure breaks none."""
    hit = lambda kind, when, grave, m: F.when(when, F.struct(F.lit(kind).alias("kind"), F.when(grave, "high").otherwise("moderate").alias("severity"), C(m).alias("metric")))
    rows = pages.where("error is null").select("doc", "page", F.explode(F.array_compact(F.array(*[hit(*r) for r in page_rules()]))).alias("d"))
    return rows.select("doc", "page", "d.*")


def imbalances(pages: DataFrame) -> DataFrame:
    """A document of three readable pages or more whose ink differs tenfold, or by 0.3, has one defect on page 0."""
    ink = C("ink_ratio")
    g = pages.where("error is null").groupBy("doc").agg(F.count(ink).alias("n"), F.max(ink).alias("hi"), F.min(F.when(ink > 0.005, ink)).alias("lo"))
    odd = g.where((C("n") >= 3) & ((C("hi") / C("lo") >= 10) | (C("hi") - C("lo") >= 0.30)))
    return odd.select("doc", F.lit(0).cast("long").alias("page"), F.lit("density_imbalance").alias("kind"), F.lit("moderate").alias("severity"), F.round(C("hi") / C("lo"), 1).alias("metric"))


def defects(pages: DataFrame) -> DataFrame:
    return page_defects(pages).unionByName(imbalances(pages))


def summaries(pages: DataFrame) -> DataFrame:
    """One row a document: pages, readable pages' ink, number of defects and the worst severity (null without any)."""
    ink = F.when(C("error").isNull(), C("ink_ratio"))
    g = pages.groupBy("doc").agg(F.count("*").alias("n"), F.round(F.avg(ink), 4).alias("ink_mean"), F.min(ink).alias("ink_min"), F.max(ink).alias("ink_max"))
    d = defects(pages).groupBy("doc").agg(F.count("*").alias("n_defects"), F.bool_or(C("severity") == "high").alias("grave"))
    worst = F.when(C("grave"), "high").when(C("n_defects") > 0, "moderate")
    return g.join(d, "doc", "left").select("doc", "n", "ink_mean", "ink_min", "ink_max", F.coalesce("n_defects", F.lit(0)).cast("long").alias("n_defects"), worst.alias("severity_max"))


def costs(pages: DataFrame) -> DataFrame:
    """doc, page, kind and cost w of the page defects that cost something."""
    w = F.element_at(F.create_map(*[F.lit(x) for kv in COSTS.items() for x in kv]), C("kind")) * F.when(C("severity") == "high", 1.0).otherwise(MODERATE)
    return page_defects(pages).where(C("kind").isin(*COSTS)).select("doc", "page", "kind", w.alias("w"))


def attributed(pages: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Costs of items by page, and by document those that no page accounts for.

    pages: doc, page, a (soft loss, may be null), unique; items: doc, page (null where it has none), w. Items are summed by
    page before they meet the pages; what meets none goes to its document. p, a and n of a page; total and unattributed
    costs of a document.
    """
    sums = items.groupBy("doc", "page").agg(F.sum("w").alias("p"), F.count("*").alias("n"))
    here = pages.select(C("doc").alias("d"), C("page").alias("g"), F.coalesce("a", F.lit(0.0)).alias("a"))
    j = cut(sums.join(here, (C("doc") == C("d")) & (C("page") == C("g")), "full"))
    rows = j.where("g is not null").select(C("d").alias("doc"), C("g").alias("page"), F.coalesce("p", F.lit(0.0)).alias("p"), "a", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    lost = j.where("n is not null").groupBy("doc").agg(F.sum("p").alias("total"), F.sum(F.when(C("g").isNull(), C("p")).otherwise(0.0)).alias("unattributed"), F.sum(F.when(C("g").isNull(), C("n")).otherwise(0)).alias("n_unattributed"))
    return rows, lost


def worst_pages(rows: DataFrame, k: int = 3, parts: int = 64) -> DataFrame:
    """doc and its k costliest pages in order, by p, then a, then page. Each part of a document gives its k worst first."""
    order = (F.desc("p"), F.desc("a"), "page")
    few = rows.withColumn("part", F.pmod("page", F.lit(parts))).withColumn("r", F.row_number().over(W.partitionBy("doc", "part").orderBy(*order))).where(C("r") <= k)
    top = few.withColumn("r", F.row_number().over(W.partitionBy("doc").orderBy(*order))).where(C("r") <= k)
    return top.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "page"))), lambda x: x["page"]).alias("worst"))


def attribution_summary(rows: DataFrame, lost: DataFrame) -> DataFrame:
    """One row a document: means, means of the worst 5 % (one page at least), peaks, totals, what is unattributed, worst pages."""
    top = lambda c: top_share(rows, ["doc"], c).select("doc", C("top_mean").alias(f"{c}_top"))
    peaks = rows.groupBy("doc").agg(F.count("*").alias("pages"), *[f(c).alias(f"{c}_{n}") for c in ("p", "a") for n, f in (("mean", F.avg), ("peak", F.max))])
    j = peaks.join(top("p"), "doc").join(top("a"), "doc").join(worst_pages(rows), "doc").join(lost, "doc", "full")
    number = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return j.select(
        "doc", F.coalesce("pages", F.lit(0)).cast("long").alias("pages"), *[number(c) for c in ("p_mean", "p_top", "p_peak")], number("total"), number("unattributed"),
        F.coalesce("n_unattributed", F.lit(0)).cast("long").alias("n_unattributed"), "a_mean", "a_top", "a_peak", "worst",
    )


def sample_anomalies(samples: DataFrame, official: DataFrame) -> DataFrame:
    """sample and kind of each measure that is implausible or differs from the venue's official value.

    official has one row a venue: page_limit, columns, paper, font. A value that either side lacks is no anomaly.
    """
    m, pages = (lambda c: C(f"measured.{c}")), C("measured.content_pages")
    rules = {
        "refs_zero": m("refs") == 0,
        "content_pages_implausible": pages < 4,
        "content_pages_over_limit": (pages >= 4) & (pages > C("page_limit") + 6),
        "fig_width_frac_gt_1": m("figure_geometry.fig_width_frac_median") > 1.001,
        "columns_mismatch": m("columns") != C("columns"),
        "paper_size_mismatch": m("paper_size") != C("paper"),
        "body_font_mismatch": F.abs(m("body_font_pt") - C("font")) > 1.0,
    }
    kinds = F.array_compact(F.array(*[F.when(when, kind) for kind, when in rules.items()]))
    return samples.join(official, "venue", "left").select("sample", "venue", F.explode(kinds).alias("kind"))
