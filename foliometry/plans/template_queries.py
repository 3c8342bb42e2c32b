"""Queries of measured samples and venue templates: samples from orders and their lines, constraints from parts, rules from suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliometry.functions.scalar import r6
from foliometry.operators import templates
from foliometry.operators.lineage import cut
from foliometry.plans.registry import Tables, query, with_views

#: Expressions of the stand-in samples, read alike by both engines: k is the order, v its venue's number, n and q lines and quantity.
SAMPLE = {
    "pdf_pages": "8 + 2 * n", "content_pages": "CASE WHEN k % 17 = 0 THEN 0 ELSE 4 + n + k % 3 END", "body_font_pt": "9 + v % 3 + (k % 5) * 0.125", "text_width_pt": "380 + (v % 5) * 30 + k % 11",
    "columns": "1 + (v + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) % 2", "column_gap_pt": "16 + k % 9", "figures": "floor(q / 20)", "tables": "CASE WHEN v % 4 = 1 THEN 5 + k % 4 ELSE k % 4 END",
    "equations": "(k * 7 % 40) * (v % 3)", "algorithms": "CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END", "refs": "10 + k % (20 + v)", "footnotes_est": "k % 4",
    "caption_font_pt": "CASE WHEN v % 4 <> 3 OR k % 50 = 0 THEN 8 + (k % 3) * 0.5 END", "lines_per_page": "40 + k % 30",
}
MARGINS = {"left": "15 + v % 9 + (k % 4) * 0.5", "right": "16 + v % 7 + (k % 3) * 0.5", "top": "18 + k % 6", "bottom": "CASE WHEN k % 10 <> 0 THEN 20 + v % 4 END"}
FIGURE = {"fig_width_frac_median": "(4 + k % (5 + v % 4)) * 0.125", "fig_height_frac_median": "(2 + k % 5) * 0.125", "full_width_fig_frac": "(k % 8) * 0.125"}
FLOATS = {"top": "(k % 4) * (1 + v % 3)", "mid": "k % 3", "bottom": "k % (2 + v % 5)"}
STYLE = "CASE WHEN (v + k % 3) % 2 = 0 THEN 'numeric' ELSE 'author-year' END"
KEYS = ("page_limit_content", "columns", "margin_left_mm", "margin_right_mm", "body_font_size_pt", "page_limit_total", "margin_top_mm", "margin_bottom_mm", "text_width_mm", "column_gap_mm", "paper_size")
BASES = ("official", "template-implied", "inferred", "derived", "unknown")
VALUE = """CASE key WHEN 'page_limit_content' THEN 7 + z % 6 WHEN 'page_limit_total' THEN 10 + z % 8 WHEN 'columns' THEN 1 + z % 2 WHEN 'body_font_size_pt' THEN 9 + z % 4
  WHEN 'text_width_mm' THEN 150 + z WHEN 'column_gap_mm' THEN 5 + z % 5 WHEN 'paper_size' THEN NULL ELSE 14 + z % 12 END"""
APPLIES = "CASE WHEN s_suppkey % 9 = 0 THEN 'All venues' ELSE 'V' || CAST(s_nationkey AS STRING) || ', v' || CAST((s_nationkey + 3) % 25 AS STRING) END"


def samples(t: Tables) -> DataFrame:
    """sample, venue and the struct measured."""
    lines = t["lineitem"].groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    rows = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = rows.select(F.col("o_orderkey").alias("k"), F.col("c_nationkey").cast("long").alias("v"), "n", "q")
    of = lambda d: [F.expr(e).cast("double").alias(c) for c, e in d.items()]
    paper = F.when(F.col("k") % 3 == 0, "a4").otherwise("letter").alias("paper_size")
    measured = F.struct(*of(SAMPLE), F.struct(*of(MARGINS)).alias("margins_mm"), F.struct(*of(FIGURE)).alias("figure_geometry"), F.struct(*of(FLOATS)).alias("full_width_float_pos"), F.expr(STYLE).alias("ref_style"), paper)
    return rows.select(F.col("k").alias("sample"), F.concat(F.lit("v"), F.col("v").cast("string")).alias("venue"), measured.alias("measured"))


def constraints(t: Tables) -> DataFrame:
    """venue, key, edition, value or text, basis."""
    p = F.col("p_partkey")
    at = ((p - p % 25) / 25 % len(KEYS)).cast("int")
    rows = t["part"].select(F.concat(F.lit("v"), (p % 25).cast("string")).alias("venue"), F.array(*map(F.lit, KEYS))[at].alias("key"), p.alias("edition"), F.col("p_size").cast("long").alias("z"))
    given = F.col("z") % 7 != 0
    return rows.select("venue", "key", "edition", F.when(given, F.expr(VALUE)).cast("double").alias("value"), F.when(given & (F.col("key") == "paper_size"), F.when(F.col("z") % 2 == 0, "a4").otherwise("letter")).alias("text"),
                       F.when(F.col("z") % 6 < 5, F.array(*map(F.lit, BASES))[(F.col("z") % 6).cast("int")]).alias("basis"))


def rules(t: Tables) -> DataFrame:
    return t["supplier"].select(F.col("s_suppkey").alias("id"), F.expr(APPLIES).alias("applies_to"))


_named = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in {**SAMPLE, **{f"margins_{s}_mm": e for s, e in MARGINS.items()}, **FIGURE, **{f"pos_{p}": e for p, e in FLOATS.items()}}.items())
SAMPLES_SQL = f"""
s_ AS (SELECT k AS sample, 'v' || v AS venue, {_named}, {STYLE} AS ref_style
  FROM (SELECT o_orderkey AS k, CAST(c_nationkey AS BIGINT) AS v, n, q FROM orders JOIN customer ON o_custkey = c_custkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey))"""
MEASURED_SQL = """
w_ AS (SELECT sample, venue, pdf_pages, content_pages, body_font_pt, text_width_pt, CASE WHEN columns = 2 THEN column_gap_pt END AS column_gap_pt,
    margins_left_mm, margins_right_mm, margins_top_mm, margins_bottom_mm, figures, tables, equations, algorithms, refs, footnotes_est,
    CASE WHEN content_pages > 0 THEN figures / content_pages END AS figs_per_page, CASE WHEN content_pages > 0 THEN tables / content_pages END AS tables_per_page,
    CASE WHEN content_pages > 0 THEN equations / content_pages END AS equations_per_page, fig_width_frac_median, fig_height_frac_median, full_width_fig_frac,
    caption_font_pt, lines_per_page FROM s_),
l_ AS (SELECT sample, venue, metric, value FROM w_ UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* EXCLUDE (sample, venue))))),
m_ AS (SELECT venue, metric, count(value) AS n, min(value) AS least, quantile_cont(value, 0.25) AS low, median(value) AS median, quantile_cont(value, 0.75) AS high, max(value) AS most
  FROM l_ GROUP BY ALL HAVING count(value) > 0)"""
_keys = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"
_bases = "[" + ", ".join(f"'{b}'" for b in BASES) + "]"
TEMPLATE_SQL = f"""
c_ AS (SELECT 'v' || (p_partkey % 25) AS venue, {_keys}[p_partkey // 25 % {len(KEYS)} + 1] AS key, p_partkey AS edition, CAST(p_size AS BIGINT) AS z FROM part),
k_ AS (SELECT venue, key, CASE WHEN z % 7 <> 0 THEN CAST({VALUE} AS DOUBLE) END AS value, CASE WHEN z % 7 <> 0 AND key = 'paper_size' THEN CASE WHEN z % 2 = 0 THEN 'a4' ELSE 'letter' END END AS text,
    CASE WHEN z % 6 < 5 THEN {_bases}[z % 6 + 1] END AS basis
  FROM c_ QUALIFY row_number() OVER (PARTITION BY venue, key ORDER BY edition DESC) = 1),
o_ AS (SELECT venue, {", ".join(f"max(value) FILTER (key = '{k}') AS {k}, max(basis) FILTER (key = '{k}' AND value IS NOT NULL) AS {k}_b" for k in KEYS if k != "paper_size")},
  max(text) FILTER (key = 'paper_size') AS paper FROM k_ WHERE value IS NOT NULL OR text IS NOT NULL GROUP BY 1),
y_ AS (SELECT venue, {", ".join(f"max(median) FILTER (metric = '{m}') AS {m}" for m, _, _ in templates.PLAIN)}, max(median) FILTER (metric = 'column_gap_pt') AS gap_pt,
  {", ".join(f"max(median) FILTER (metric = '{m}') AS {m}" for m in templates.BY_PAGE.values())}, max(n) FILTER (metric = 'caption_font_pt') AS n_captions,
  max(most) FILTER (metric = 'fig_width_frac_median') AS widest FROM m_ GROUP BY 1),
n_ AS (SELECT venue, count(*) AS n_samples, sum(pos_top) AS top, sum(pos_mid) AS mid, sum(pos_bottom) AS bottom FROM s_ GROUP BY 1),
seen_ AS (SELECT venue, columns AS cols_seen FROM s_ GROUP BY venue, columns QUALIFY row_number() OVER (PARTITION BY venue ORDER BY count(*) DESC, columns) = 1),
style_ AS (SELECT venue, ref_style FROM s_ GROUP BY venue, ref_style QUALIFY row_number() OVER (PARTITION BY venue ORDER BY count(*) DESC, ref_style) = 1),
rule_ AS (SELECT s_suppkey AS id, lower({APPLIES}) AS applies FROM supplier),
a_ AS (SELECT *, coalesce(o_.columns, cols_seen) AS cols, coalesce(coalesce(o_.columns, cols_seen) = 2, false) AS two, CASE WHEN paper = 'a4' THEN 210.0 ELSE 215.9 END AS page_mm,
    coalesce(margin_left_mm, margins_left_mm) AS left_, coalesce(margin_right_mm, margins_right_mm) AS right_, coalesce(margin_top_mm, margins_top_mm) AS top_, coalesce(margin_bottom_mm, margins_bottom_mm) AS bottom_,
    coalesce(page_limit_content, page_limit_total) - nullif(content_pages, 0) AS slack
  FROM o_ FULL JOIN y_ USING (venue) FULL JOIN n_ USING (venue) FULL JOIN seen_ USING (venue) FULL JOIN style_ USING (venue)),
b_ AS (SELECT *, least(left_, right_, top_, bottom_) AS floor_,
    coalesce(text_width_mm, round(page_mm - margin_left_mm - margin_right_mm, 1), round(text_width_pt * 25.4 / 72, 1)) AS text_,
    coalesce(column_gap_mm, CASE WHEN two THEN round(gap_pt * 25.4 / 72, 2) END) AS gap_,
    {", ".join(f"CASE WHEN margin_{s}_mm IS NOT NULL THEN coalesce(margin_{s}_mm_b, 'official') WHEN margins_{s}_mm IS NOT NULL THEN 'sample-stat' END AS {s}_b" for s in templates.SIDES)} FROM a_),
t_ AS (SELECT venue, coalesce(n_samples, 0) AS n_samples, CASE WHEN coalesce(n_samples, 0) <= 6 THEN 'low' WHEN n_samples <= 9 THEN 'medium' ELSE 'high' END AS level, CAST(cols AS BIGINT) AS columns,
    CASE WHEN b_.columns IS NOT NULL THEN 'official' WHEN cols_seen IS NOT NULL THEN 'sample-stat' END AS columns_basis, coalesce(paper, 'letter') AS paper, round(text_, 6) AS text_width_mm,
    CASE WHEN text_width_mm IS NOT NULL THEN coalesce(text_width_mm_b, 'template-implied') WHEN margin_left_mm + margin_right_mm IS NOT NULL THEN 'derived' WHEN text_width_pt IS NOT NULL THEN 'sample-stat' END AS text_width_basis,
    round(gap_, 6) AS column_gap_mm, CASE WHEN column_gap_mm IS NOT NULL THEN coalesce(column_gap_mm_b, 'template-implied') WHEN gap_ IS NOT NULL THEN 'sample-stat' END AS column_gap_basis,
    CASE WHEN two THEN round((text_ - gap_) / 2, 1) END AS column_width_mm, {", ".join(f"round({s}_, 6) AS margin_{s}_mm, {s}_b AS margin_{s}_basis" for s in templates.SIDES)}, round(floor_, 6) AS margin_floor_mm,
    CASE WHEN floor_ IS NOT NULL THEN CASE WHEN {" AND ".join(f"coalesce({s}_b IN ('official', 'template-implied'), false)" for s in templates.SIDES)} THEN 'official' ELSE 'sample-stat' END END AS margin_floor_basis,
    round(coalesce(body_font_size_pt, body_font_pt), 6) AS body_font_pt, CASE WHEN body_font_size_pt IS NOT NULL THEN coalesce(body_font_size_pt_b, 'sample-stat') WHEN body_font_pt IS NOT NULL THEN 'sample-stat' END AS body_font_basis,
    coalesce(abs(body_font_size_pt - body_font_pt) <= 0.5, false) AS body_font_agrees, round(caption_font_pt, 6) AS caption_font_pt, coalesce(n_captions >= 5, false) AS caption_reliable,
    NOT two AND coalesce(widest <= 1.001, true) AS figure_width_reliable,
    CASE WHEN top / nullif(top + mid + bottom, 0) >= 0.55 THEN 'top' WHEN bottom / nullif(top + mid + bottom, 0) >= 0.3 THEN 'both' ELSE 'few' END AS float_position,
    page_limit_content, coalesce(page_limit_content_b, 'official') AS page_limit_content_basis, page_limit_total, coalesce(page_limit_total_b, 'official') AS page_limit_total_basis, round(slack, 6) AS page_slack,
    (SELECT count(*) FROM rule_ WHERE applies LIKE 'all %' OR list_contains(string_split(applies, ', '), b_.venue)) AS n_rules,
    two, slack, floor_, text_width_pt, coalesce(figs_per_page, 0) AS f, coalesce(tables_per_page, 0) AS tb, coalesce(equations_per_page, 0) AS e, coalesce(full_width_fig_frac, 0) AS w, ref_style, refs FROM b_)"""
VIEWS = (SAMPLES_SQL, MEASURED_SQL, TEMPLATE_SQL)


def template(t: Tables) -> DataFrame:
    return templates.venue_templates(constraints(t), cut(samples(t)), rules(t))


@query("derived_metrics", with_views(SAMPLES_SQL, MEASURED_SQL, body="SELECT sample, venue, metric, round(value, 6) AS value FROM l_"))
def derived_metrics(t: Tables) -> DataFrame:
    """All 23 measures of each sample."""
    return templates.measured_long(samples(t), ["sample", "venue"]).select("sample", "venue", "metric", r6("value").alias("value"))


@query("measured_stats", with_views(SAMPLES_SQL, MEASURED_SQL, body="SELECT venue, metric, n, round(least, 6) AS least, round(low, 6) AS low, round(median, 6) AS median, round(high, 6) AS high, round(most, 6) AS most FROM m_"))
def measured_stats(t: Tables) -> DataFrame:
    names = ("least", "low", "median", "high", "most")
    stats = templates.measured_stats(samples(t)).where("n > 0")
    return stats.select("venue", "metric", "n", *[r6(F.col("p")[i]).alias(n) for i, n in enumerate(names)])


@query("venue_template", with_views(*VIEWS, body="SELECT * EXCLUDE (two, slack, floor_, text_width_pt, f, tb, e, w, ref_style, refs) FROM t_"))
def venue_template(t: Tables) -> DataFrame:
    """The single values of each venue's template."""
    return template(t).drop("density", "priorities")


@query("template_targets", with_views(*VIEWS, body="""SELECT v.venue, target, coalesce(n, 0) AS n, round(low, 6) AS low, round(median, 6) AS median, round(high, 6) AS high,
  round(CASE target WHEN 'figures' THEN pf WHEN 'tables' THEN pt WHEN 'equations' THEN pe END, 6) AS per_page,
  CASE target WHEN 'refs' THEN coalesce(ref_style = 'numeric' AND refs >= 20, false) ELSE target NOT IN ('footnotes_est', 'lines_per_page') END AS reliable
FROM (SELECT t_.venue, t_.ref_style, t_.refs, figs_per_page AS pf, tables_per_page AS pt, equations_per_page AS pe,
    unnest(['figures', 'tables', 'equations', 'algorithms', 'footnotes_est', 'refs', 'lines_per_page', 'content_pages']) AS target FROM t_ LEFT JOIN y_ USING (venue)) v
  LEFT JOIN m_ ON m_.venue = v.venue AND metric = target"""))  # fmt: skip
def template_targets(t: Tables) -> DataFrame:
    """Targets of density with their quarters and whether they are reliable."""
    return template(t).select("venue", F.explode("density").alias("d")).select("venue", "d.*")


@query("template_priorities", with_views(*VIEWS, body="""SELECT venue, row_number() OVER (PARTITION BY venue ORDER BY c.score DESC, seq) AS rank, c.family AS family, round(c.score, 6) AS score
FROM (SELECT venue, unnest(l) AS c, unnest(range(len(l))) AS seq FROM (SELECT venue, [
  {'family': 'L', 'score': 1000.0}, CASE WHEN slack <= 1.5 THEN {'family': 'page', 'score': 60 + 20 * (1.5 - slack)} END, CASE WHEN slack >= 3 THEN {'family': 'page', 'score': 30 + 4 * slack} END,
  CASE WHEN slack <= 1.5 AND floor_ <= 20 THEN {'family': 'margin', 'score': 50 - floor_} END, {'family': 'float', 'score': 45 + 22 * f + 18 * w}, CASE WHEN tb >= 0.35 THEN {'family': 'table', 'score': 28 + 45 * tb} END,
  CASE WHEN e >= 1 THEN {'family': 'equation', 'score': 30 + 28 * e} END, CASE WHEN e < 0.5 THEN {'family': 'equation', 'score': 20.0} END,
  CASE WHEN NOT two AND text_width_pt < 420 THEN {'family': 'breaking', 'score': 58.0} END, CASE WHEN two THEN {'family': 'span', 'score': 34 + 30 * w} END, {'family': 'fallback', 'score': 10.0}] AS l FROM t_))
WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY venue ORDER BY c.score DESC, seq) <= 5"""))  # fmt: skip
def template_priorities(t: Tables) -> DataFrame:
    """What to improve at a venue, best first, one a family."""
    rows = template(t).select("venue", F.posexplode("priorities").alias("i", "c"))
    return rows.select("venue", (F.col("i") + 1).cast("long").alias("rank"), "c.family", r6("c.score").alias("score"))


@query("spec_projection", with_views(*VIEWS, """f_ AS (SELECT venue, CASE WHEN page_limit_content IS NOT NULL THEN 'content' ELSE 'total' END AS scope, unnest([
  {'field': 'page_limit', 'hard': true, 'v': coalesce(page_limit_content, page_limit_total), 's': NULL, 'b': CASE WHEN page_limit_content IS NOT NULL THEN page_limit_content_basis ELSE page_limit_total_basis END,
   'path': CASE WHEN page_limit_content IS NOT NULL THEN 'hard_constraints.page_limit_content' ELSE 'hard_constraints.page_limit_total' END},
  {'field': 'font_pt', 'hard': true, 'v': body_font_pt, 's': NULL, 'b': body_font_basis, 'path': 'typography.body_font_pt'}, {'field': 'margin_mm', 'hard': true, 'v': margin_floor_mm, 's': NULL, 'b': margin_floor_basis, 'path': 'geometry.margin_floor_mm'},
  {'field': 'float_spec', 'hard': false, 'v': NULL, 's': 'tbp', 'b': 'derived', 'path': 'float_policy.float_spec'},
  {'field': 'overwide_fig_threshold_mm', 'hard': false, 'v': text_width_mm, 's': NULL, 'b': 'derived', 'path': 'float_policy.figure_width.overwide_threshold_mm'},
  {'field': 'eq_fleqn_allowed', 'hard': false, 'v': 0.0, 's': NULL, 'b': 'derived', 'path': 'flat.eq_fleqn_allowed'}, {'field': 'enable_quality_macros', 'hard': false, 'v': 1.0, 's': NULL, 'b': 'derived', 'path': 'flat.enable_quality_macros'}]) AS r FROM t_)""",
  """g_ AS (SELECT venue, scope, r.field AS field, r.v AS v, r.s AS s, r.path AS path, r.v IS NOT NULL OR r.s IS NOT NULL AS given, CASE WHEN r.v IS NOT NULL OR r.s IS NOT NULL THEN r.b END AS basis,
    (r.v IS NOT NULL OR r.s IS NOT NULL) AND (r.b IN ('official', 'template-implied', 'inferred') OR (NOT r.hard AND r.b = 'derived')) AS ok FROM f_)""",
  body="SELECT venue, scope, field, CASE WHEN ok THEN v END AS value, CASE WHEN ok THEN s END AS text, path, basis, coalesce(ok, false) AS accepted, CASE WHEN NOT given THEN 'no value' WHEN NOT ok THEN 'basis not permitted' END AS reason FROM g_"))
def spec_projection(t: Tables) -> DataFrame:
    """Fields of a requirement from each venue's template, by permitted bases."""
    return templates.projected(template(t))
