"""Templates of venues: official values first, measured ones otherwise, each with its basis; what to improve, ranked.

Samples are one row a paper with a struct `measured`, constraints one row a venue, key and edition. Strata of measures may be
of any size (`quantiles.percentiles`); what meets in one row is bounded by the number of measures and of known keys.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliometry.functions.scalar import r6
from foliometry.operators import quantiles

#: Names, units and places of the measures read as they are.
PLAIN = (
    ("pdf_pages", "pages", "pdf_pages"), ("content_pages", "pages", "content_pages"), ("body_font_pt", "pt", "body_font_pt"), ("text_width_pt", "pt", "text_width_pt"),
    ("margins_left_mm", "mm", "margins_mm.left"), ("margins_right_mm", "mm", "margins_mm.right"), ("margins_top_mm", "mm", "margins_mm.top"),
    ("margins_bottom_mm", "mm", "margins_mm.bottom"), ("figures", "per_paper", "figures"), ("tables", "per_paper", "tables"), ("equations", "per_paper", "equations"),
    ("algorithms", "per_paper", "algorithms"), ("refs", "per_paper", "refs"), ("footnotes_est", "per_paper", "footnotes_est"),
    ("fig_width_frac_median", "ratio", "figure_geometry.fig_width_frac_median"), ("fig_height_frac_median", "ratio", "figure_geometry.fig_height_frac_median"),
    ("full_width_fig_frac", "ratio", "figure_geometry.full_width_fig_frac"), ("caption_font_pt", "pt", "caption_font_pt"), ("lines_per_page", "per_page", "lines_per_page"),
)
#: Counts that are also given by content page, and how these are called.
BY_PAGE = {"figures": "figs_per_page", "tables": "tables_per_page", "equations": "equations_per_page"}
#: Bases that a hard limit and a policy accept.
HARD = ("official", "template-implied", "inferred")
POLICY = (*HARD, "derived")
#: Field of a requirement, its kind and the template paths that may give it, best first.
FIELDS = (
    ("page_limit", "hard", ("hard_constraints.page_limit_content", "hard_constraints.page_limit_total")),
    ("font_pt", "hard", ("typography.body_font_pt",)),
    ("margin_mm", "hard", ("geometry.margin_floor_mm",)),
    ("float_spec", "policy", ("float_policy.float_spec",)),
    ("overwide_fig_threshold_mm", "policy", ("float_policy.figure_width.overwide_threshold_mm",)),
    ("eq_fleqn_allowed", "flat", ("flat.eq_fleqn_allowed",)),
    ("enable_quality_macros", "flat", ("flat.enable_quality_macros",)),
)
#: Page widths in mm; mm of a point.
PAGE_MM = {"letter": 215.9, "a4": 210.0}
MM_OF_PT = 25.4 / 72
SIDES = ("left", "right", "top", "bottom")
TARGETS = ("figures", "tables", "equations", "algorithms", "footnotes_est", "refs", "lines_per_page", "content_pages")
QS = (0.0, 0.25, 0.5, 0.75, 1.0)


def measures() -> list[tuple[str, str, Column]]:
    """The 23 measures of a sample. A ratio to content pages is null where these are null or 0, a gap where there are not two columns."""
    pages = F.col("measured.content_pages")
    out = [(name, unit, F.col(f"measured.{path}")) for name, unit, path in PLAIN]
    out.append(("column_gap_pt", "pt", F.when(F.col("measured.columns") == 2, F.col("measured.column_gap_pt"))))
    return out + [(name, "per_page", F.try_divide(F.col(f"measured.{count}"), F.nullif(pages, F.lit(0)))) for count, name in BY_PAGE.items()]


def measured_long(samples: DataFrame, ids: list[str]) -> DataFrame:
    """One row a sample and measure: ids, metric, unit, value (null where it is not given). No shuffle."""
    cells = [F.struct(F.lit(n).alias("metric"), F.lit(u).alias("unit"), v.cast("double").alias("value")) for n, u, v in measures()]
    return samples.select(*ids, F.explode(F.array(*cells)).alias("m")).select(*ids, "m.*")


def measured_stats(samples: DataFrame, venue: str = "venue") -> DataFrame:
    """venue, metric, n and quantiles p (least, lower quarter, median, upper quarter, most)."""
    return quantiles.percentiles(measured_long(samples, [venue]), [venue, "metric"], QS)


def latest_constraints(constraints: DataFrame) -> DataFrame:
    """One row a venue with a map of its keys' last editions: value, text and basis. Keys whose last edition has neither are left out."""
    last = constraints.groupBy("venue", "key").agg(F.max_by(F.struct("value", "text", "basis"), "edition").alias("v"))
    said = last.where(F.col("v.value").isNotNull() | F.col("v.text").isNotNull())
    return said.groupBy("venue").agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("official"))


def _common(samples: DataFrame, column: Column, out: str) -> DataFrame:
    """The most frequent value of a venue; of equal counts the smallest value."""
    counts = samples.select("venue", column.alias("v")).where("v is not null").groupBy("venue", "v").count()
    return counts.groupBy("venue").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias(out))


def picked(cands: Column, least: int = 3, most: int = 5, free: tuple[str, ...] = ("page",)) -> Column:
    """Of an array of structs (family, score, ...) the best by score, one a family but for free ones, at most `most`.

    Equal scores keep their order. Where fewer than `least` are found, the best of the others fill up. The array is small.
    """
    empty = F.filter(cands, lambda c: F.lit(False))
    placed = F.transform(cands, lambda c, i: F.struct((-c["score"]).alias("s"), i.alias("i"), c.alias("c")))
    ordered = F.transform(F.array_sort(placed), lambda p: p["c"])

    def take(got: Column, c: Column) -> Column:
        seen = F.exists(got, lambda g: g["family"] == c["family"]) & ~c["family"].isin(*free)
        return F.when(seen | (F.size(got) >= most), got).otherwise(F.array_append(got, c))

    best = F.aggregate(ordered, empty, take)
    rest = F.filter(ordered, lambda c: ~F.array_contains(best, c))
    return F.when(F.size(best) < least, F.concat(best, F.slice(rest, 1, F.greatest(F.lit(0), F.lit(least) - F.size(best))))).otherwise(best)


def _first(*options: tuple[Column, Column]) -> Column:
    """The first (value, basis) whose value is given."""
    return F.coalesce(*[F.when(v.isNotNull(), F.struct(v.cast("double").alias("value"), b.alias("basis"))) for v, b in options])


def _priorities(row: Mapping[str, Column], median: Mapping[str, Column]) -> Column:
    """Candidates that apply, with their scores (fixed values)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    slack, floor, full = row["slack"], row["floor"], zero(median["full_width_fig_frac"])
    figs, tabs, eqs = (zero(median[n]) for n in BY_PAGE.values())
    yes = F.lit(True)
    cands = [
        ("L", yes, F.lit(1000.0)),
        ("page", slack <= 1.5, 60 + 20 * (1.5 - slack)),
        ("page", slack >= 3, 30 + 4 * slack),
        ("margin", (slack <= 1.5) & (floor <= 20), 50 - floor),
        ("float", yes, 45 + 22 * figs + 18 * full),
        ("table", tabs >= 0.35, 28 + 45 * tabs),
        ("equation", eqs >= 1, 30 + 28 * eqs),
        ("equation", eqs < 0.5, F.lit(20.0)),
        ("breaking", ~row["two"] & (F.coalesce(F.nullif(median["text_width_pt"], F.lit(0.0)), F.lit(999.0)) < 420), F.lit(58.0)),
        ("span", row["two"], 34 + 30 * full),
        ("fallback", yes, F.lit(10.0)),
    ]
    items = F.array(*[F.when(when, F.struct(F.lit(f).alias("family"), score.cast("double").alias("score"))) for f, when, score in cands])
    return picked(F.filter(items, lambda c: c.isNotNull()))


def venue_templates(constraints: DataFrame, samples: DataFrame, rules: DataFrame) -> DataFrame:
    """One row a venue that has constraints or samples; a value neither gives is null.

    Rows without a venue are left out. rules have id and applies_to, which names venues or says `all`; n_rules counts those
    that apply, one that says both once. density lists the targets with their quarters and whether
    they are reliable; priorities are ranked.
    """
    constraints, samples = constraints.where("venue is not null and key is not null"), samples.where("venue is not null")
    stat = F.struct("n", F.col("p")[0].alias("least"), F.col("p")[1].alias("low"), F.col("p")[2].alias("median"), F.col("p")[3].alias("high"), F.col("p")[4].alias("most"))
    stats = measured_stats(samples).groupBy("venue").agg(F.map_from_entries(F.collect_list(F.struct(F.col("metric"), stat))).alias("stats"))
    pos = {p: F.sum(f"measured.full_width_float_pos.{p}") for p in ("top", "mid", "bottom")}
    counts = samples.groupBy("venue").agg(F.count("*").alias("n_samples"), *[c.alias(f"pos_{p}") for p, c in pos.items()])
    common = [_common(samples, F.col("measured.columns"), "cols_seen"), _common(samples, F.col("measured.paper_size"), "paper_seen"), _common(samples, F.col("measured.ref_style"), "ref_style")]
    words = rules.select("id", F.explode(F.array_distinct(F.split(F.lower("applies_to"), "[^a-z0-9]+"))).alias("word"), F.array_contains(F.split(F.lower("applies_to"), "[^a-z0-9]+"), "all").alias("general"))
    named = words.where("not general").groupBy(F.col("word").alias("venue")).agg(F.count("*").alias("named"))
    general = words.where("general and word = 'all'").count()
    base = reduce(lambda a, b: a.join(b, "venue", "full"), [latest_constraints(constraints), stats, counts, *common]).join(named, "venue", "left")

    said = lambda k: F.col("official")[k]["value"]
    basis = lambda k, default: F.coalesce(F.col("official")[k]["basis"], F.lit(default))
    seen = {n: F.col("stats")[n] for n in [m[0] for m in measures()]}
    median = {n: c["median"] for n, c in seen.items()}
    sample, derived = F.lit("sample-stat"), F.lit("derived")

    sides = {s: _first((said(f"margin_{s}_mm"), basis(f"margin_{s}_mm", "official")), (median[f"margins_{s}_mm"], sample)) for s in SIDES}
    out = base.select("*", *[c.alias(f"__{s}") for s, c in sides.items()], _first((said("columns"), F.lit("official")), (F.col("cols_seen"), sample)).alias("__cols"))
    two = F.coalesce(F.col("__cols.value") == 2, F.lit(False))
    paper = F.coalesce(F.col("official")["paper_size"]["text"], F.lit("letter"))
    width = F.when(paper == "a4", PAGE_MM["a4"]).otherwise(PAGE_MM["letter"])
    left, right = said("margin_left_mm"), said("margin_right_mm")
    text_w = _first(
        (said("text_width_mm"), basis("text_width_mm", "template-implied")),
        (F.when((left != 0) & (right != 0), F.round(width - left - right, 1)), derived),
        (F.round(median["text_width_pt"] * MM_OF_PT, 1), sample),
    )
    gap = _first((said("column_gap_mm"), basis("column_gap_mm", "template-implied")), (F.when(two & (median["column_gap_pt"] != 0), F.round(median["column_gap_pt"] * MM_OF_PT, 2)), sample))
    font = _first((said("body_font_size_pt"), basis("body_font_size_pt", "sample-stat")), (median["body_font_pt"], sample))
    all_official = reduce(Column.__and__, [F.coalesce(F.col(f"__{s}.basis").isin("official", "template-implied"), F.lit(False)) for s in SIDES])
    limit = F.coalesce(F.nullif(said("page_limit_content"), F.lit(0.0)), F.nullif(said("page_limit_total"), F.lit(0.0)))
    out = out.select(
        "*", text_w.alias("__text"), gap.alias("__gap"), font.alias("__font"), F.least(*[F.col(f"__{s}.value") for s in SIDES]).alias("__floor"), two.alias("__two"), paper.alias("__paper"),
        limit.alias("__limit"), (limit - F.nullif(median["content_pages"], F.lit(0.0))).alias("__slack"),
    )
    n = F.coalesce("n_samples", F.lit(0))
    share = lambda p: F.coalesce(F.try_divide(F.col(f"pos_{p}"), F.col("pos_top") + F.col("pos_mid") + F.col("pos_bottom")), F.lit(0.0))
    refs_ok = F.coalesce((F.col("ref_style") == "numeric") & (median["refs"] >= 20), F.lit(False))
    sure = {"refs": refs_ok, "footnotes_est": F.lit(False), "lines_per_page": F.lit(False)}
    page = lambda t: r6(median[BY_PAGE[t]]) if t in BY_PAGE else F.lit(None).cast("double")
    density = [
        F.struct(
            F.lit(t).alias("target"), F.coalesce(seen[t]["n"], F.lit(0)).cast("long").alias("n"), r6(seen[t]["low"]).alias("low"), r6(median[t]).alias("median"), r6(seen[t]["high"]).alias("high"),
            page(t).alias("per_page"), sure.get(t, F.lit(True)).alias("reliable"),
        )
        for t in TARGETS
    ]
    column_w = F.when(F.col("__two") & (F.col("__text.value") != 0) & (F.col("__gap.value") != 0), F.round((F.col("__text.value") - F.col("__gap.value")) / 2, 1))
    hint = F.when(share("top") >= 0.55, "top").when(share("bottom") >= 0.3, "both").otherwise("few")
    parts = {"slack": F.col("__slack"), "floor": F.col("__floor"), "two": F.col("__two")}
    return out.select(
        "venue", n.cast("long").alias("n_samples"), F.when(n <= 6, "low").when(n <= 9, "medium").otherwise("high").alias("level"),
        F.col("__cols.value").cast("long").alias("columns"), F.col("__cols.basis").alias("columns_basis"), F.col("__paper").alias("paper"),
        r6("__text.value").alias("text_width_mm"), F.col("__text.basis").alias("text_width_basis"), r6("__gap.value").alias("column_gap_mm"), F.col("__gap.basis").alias("column_gap_basis"),
        r6(column_w).alias("column_width_mm"), *[c for s in SIDES for c in (r6(f"__{s}.value").alias(f"margin_{s}_mm"), F.col(f"__{s}.basis").alias(f"margin_{s}_basis"))],
        r6("__floor").alias("margin_floor_mm"), F.when(F.col("__floor").isNotNull(), F.when(all_official, "official").otherwise("sample-stat")).alias("margin_floor_basis"),
        r6("__font.value").alias("body_font_pt"), F.col("__font.basis").alias("body_font_basis"),
        F.coalesce(F.abs(said("body_font_size_pt") - median["body_font_pt"]) <= 0.5, F.lit(False)).alias("body_font_agrees"),
        r6(median["caption_font_pt"]).alias("caption_font_pt"), F.coalesce(seen["caption_font_pt"]["n"] >= 5, F.lit(False)).alias("caption_reliable"),
        (~F.col("__two") & F.coalesce(seen["fig_width_frac_median"]["most"] <= 1.001, F.lit(True))).alias("figure_width_reliable"), hint.alias("float_position"),
        said("page_limit_content").alias("page_limit_content"), basis("page_limit_content", "official").alias("page_limit_content_basis"),
        said("page_limit_total").alias("page_limit_total"), basis("page_limit_total", "official").alias("page_limit_total_basis"), r6("__slack").alias("page_slack"),
        (F.coalesce("named", F.lit(0)) + F.lit(general)).cast("long").alias("n_rules"),
        F.array(*density).alias("density"), _priorities(parts, median).alias("priorities"),
    )


def projected(templates: DataFrame) -> DataFrame:
    """One row a venue and field of a requirement: value or text, the path and basis it came from, or why it was not taken.

    The first path with a value counts, and only that: a basis which the field's kind does not permit is not made good by
    another path. scope tells whether the page limit means content or all pages.
    """
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    nodes = {
        "hard_constraints.page_limit_content": (F.col("page_limit_content"), text, F.col("page_limit_content_basis")),
        "hard_constraints.page_limit_total": (F.col("page_limit_total"), text, F.col("page_limit_total_basis")),
        "typography.body_font_pt": (F.col("body_font_pt"), text, F.col("body_font_basis")),
        "geometry.margin_floor_mm": (F.col("margin_floor_mm"), text, F.col("margin_floor_basis")),
        "float_policy.float_spec": (none, F.lit("tbp"), F.lit("derived")),
        "float_policy.figure_width.overwide_threshold_mm": (F.col("text_width_mm"), text, F.lit("derived")),
        "flat.eq_fleqn_allowed": (F.lit(0.0), text, F.lit("derived")),
        "flat.enable_quality_macros": (F.lit(1.0), text, F.lit("derived")),
    }
    rows = []
    for field, kind, paths in FIELDS:
        found = [F.when(nodes[p][0].isNotNull() | nodes[p][1].isNotNull(), F.struct(nodes[p][0].alias("value"), nodes[p][1].alias("text"), F.lit(p).alias("path"), nodes[p][2].alias("basis"))) for p in paths]
        rows.append(F.struct(F.lit(field).alias("field"), F.array(*map(F.lit, HARD if kind == "hard" else POLICY)).alias("allowed"), F.lit(paths[-1]).alias("last"), F.coalesce(*found).alias("f")))
    ok = F.coalesce(F.array_contains("r.allowed", F.col("r.f.basis")), F.lit(False))
    scope = F.when(F.col("page_limit_content").isNotNull(), "content").otherwise("total")
    return templates.select("venue", scope.alias("scope"), F.explode(F.array(*rows)).alias("r")).select(
        "venue", "scope", "r.field", F.when(ok, F.col("r.f.value")).alias("value"), F.when(ok, F.col("r.f.text")).alias("text"), F.coalesce("r.f.path", "r.last").alias("path"),
        F.col("r.f.basis").alias("basis"), ok.alias("accepted"), F.when(F.col("r.f").isNull(), "no value").when(~ok, "basis not permitted").alias("reason"),
    )
