"""Queries of page images and their costs: image measures from `lineitem`, logs from `events`, anomalies of measured samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliometry.functions.scalar import r6
from foliometry.operators import page_rules, templates
from foliometry.plans.decision_queries import SEV, SEV_ROWS, SOFT_A, SOFT_B, soft
from foliometry.plans.registry import LOGS_SQL, PAGES_SQL, Tables, query, with_views
from foliometry.plans.template_queries import SAMPLES_SQL, VIEWS, constraints, samples
from foliometry.plans.text_queries import ISSUE, issues

#: Expressions of the stand-in image measures, read alike by both engines.
INK = {
    "ink_ratio": "quantity * tax / 12 + CASE WHEN page % 3 = 0 THEN 0.05 ELSE 0 END", "band": "discount * 5 - CASE WHEN page % 2 = 0 THEN 0.05 ELSE 0 END", "bottom_blank": "CASE WHEN page % 29 <> 0 THEN (page * 7 % 50) * 0.01 END",
    "max_gap": "(page * 11 % 60) * 0.01", "max_gap_at": "(page % 10) * 0.1 + 0.05",
}
ERROR = "CASE WHEN page % 41 = 0 THEN 'unreadable' END"
INK_SQL = f"ink_ AS (SELECT paper AS doc, page, {ERROR} AS error, {', '.join(f'{e} AS {c}' for c, e in INK.items())} FROM pages_)"
DEFECT_SQL = """
d_ AS (SELECT doc, page, unnest([
    CASE WHEN band >= 0.40 THEN {'kind': 'giant_content', 'severity': 'high', 'metric': band} END,
    CASE WHEN bottom_blank >= 0.35 THEN {'kind': 'bottom_blank', 'severity': 'high', 'metric': bottom_blank} WHEN bottom_blank >= 0.25 AND ink_ratio > 0.01 THEN {'kind': 'bottom_blank', 'severity': 'moderate', 'metric': bottom_blank} END,
    CASE WHEN max_gap >= 0.28 AND max_gap_at > 0.15 AND max_gap_at < 0.85 THEN {'kind': 'mid_gap', 'severity': CASE WHEN max_gap >= 0.5 THEN 'high' ELSE 'moderate' END, 'metric': max_gap} END,
    CASE WHEN ink_ratio > 0 AND ink_ratio <= 0.06 AND band >= 0.05 AND bottom_blank >= 0.30 THEN {'kind': 'stranded_block', 'severity': 'high', 'metric': ink_ratio} END,
    CASE WHEN ink_ratio > 0 AND ink_ratio <= 0.02 THEN {'kind': 'near_empty', 'severity': 'high', 'metric': ink_ratio} END]) AS d FROM ink_ WHERE error IS NULL),
i_ AS (SELECT doc, round(hi / lo, 1) AS metric FROM (SELECT doc, count(ink_ratio) AS n, max(ink_ratio) AS hi, min(ink_ratio) FILTER (ink_ratio > 0.005) AS lo FROM ink_ WHERE error IS NULL GROUP BY doc)
  WHERE n >= 3 AND (hi / lo >= 10 OR hi - lo >= 0.30)),
v_ AS (SELECT doc, page, d.kind AS kind, d.severity AS severity, d.metric AS metric FROM d_ WHERE d IS NOT NULL UNION ALL SELECT doc, 0, 'density_imbalance', 'moderate', metric FROM i_)"""


def images(t: Tables) -> DataFrame:
    return t.pages.select(F.col("paper").alias("doc"), "page", F.expr(ERROR).alias("error"), *[F.expr(e).cast("double").alias(c) for c, e in INK.items()])


@query("visual_defects", with_views(PAGES_SQL, INK_SQL, DEFECT_SQL, body="SELECT doc, page, kind, severity, round(metric, 6) AS metric FROM v_"))
def visual_defects(t: Tables) -> DataFrame:
    """Six rules of page images."""
    return page_rules.defects(images(t)).withColumn("metric", r6("metric"))


@query("visual_summary", with_views(PAGES_SQL, INK_SQL, DEFECT_SQL, body="""SELECT doc, n, ink_mean, round(ink_min, 6) AS ink_min, round(ink_max, 6) AS ink_max, coalesce(k, 0) AS n_defects, CASE WHEN grave THEN 'high' WHEN k > 0 THEN 'moderate' END AS severity_max
FROM (SELECT doc, count(*) AS n, round(avg(ink_ratio) FILTER (error IS NULL), 4) AS ink_mean, min(ink_ratio) FILTER (error IS NULL) AS ink_min, max(ink_ratio) FILTER (error IS NULL) AS ink_max FROM ink_ GROUP BY doc)
LEFT JOIN (SELECT doc, count(*) AS k, bool_or(severity = 'high') AS grave FROM v_ GROUP BY doc) USING (doc)"""))  # fmt: skip
def visual_summary(t: Tables) -> DataFrame:
    s = page_rules.summaries(images(t))
    return s.withColumns({"ink_min": r6("ink_min"), "ink_max": r6("ink_max")})


def cost_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Soft losses of pages, and costs of log lines and page images; a log line of source line n belongs to page n / 2."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in SEV_ROWS for x in kv]), F.col("kind"))
    logs = issues(t).where(F.col("kind").isin(*[k for k, _ in SEV_ROWS])).select("doc", F.floor(F.col("line_lo") / 2).alias("page"), weight.alias("w"))
    seen = page_rules.costs(images(t)).select("doc", "page", "w")
    pages = soft(t).select(F.col("paper").alias("doc"), "page", (F.col("a") + F.col("b")).alias("a"))
    return pages, logs.unionByName(seen)


COST_SQL = f"""
x_ AS (SELECT doc, CAST(floor(line_lo / 2.0) AS BIGINT) AS page, w FROM issue_ JOIN sev_ USING (kind)
  UNION ALL SELECT doc, page, CASE kind WHEN 'stranded_block' THEN 1.2 ELSE 0.6 END FROM v_ WHERE kind IN ('stranded_block', 'near_empty')),
a_ AS (SELECT paper AS doc, page, {SOFT_A} + {SOFT_B} AS a FROM pages_),
r_ AS (SELECT a_.doc, a_.page, coalesce(sum(w), 0) AS p, any_value(a) AS a, count(w) AS n FROM a_ LEFT JOIN x_ ON x_.doc = a_.doc AND x_.page = a_.page GROUP BY 1, 2),
u_ AS (SELECT x_.doc, sum(w) AS total, coalesce(sum(w) FILTER (a IS NULL), 0) AS unattributed, count(*) FILTER (a IS NULL) AS n_unattributed FROM x_ LEFT JOIN a_ ON x_.doc = a_.doc AND x_.page = a_.page GROUP BY 1)"""
COSTS = (PAGES_SQL, LOGS_SQL, ISSUE, SEV, INK_SQL, DEFECT_SQL, COST_SQL)


@query("page_attribution", with_views(*COSTS, body="SELECT doc, page, round(p, 6) AS p, round(a, 6) AS a, n FROM r_"))
def page_attribution(t: Tables) -> DataFrame:
    """Costs and soft losses of every page."""
    rows, _ = page_rules.attributed(*cost_rows(t))
    return rows.select("doc", "page", r6("p").alias("p"), r6("a").alias("a"), "n")


def _top(c: str) -> str:
    return f"avg({c}) FILTER ({c}_r <= greatest(1, round_even(0.05 * m, 0)))"


@query("attribution_summary", with_views(*COSTS, f"""q_ AS (SELECT *, count(*) OVER (PARTITION BY doc) AS m, row_number() OVER (PARTITION BY doc ORDER BY p DESC) AS p_r, row_number() OVER (PARTITION BY doc ORDER BY a DESC) AS a_r,
    row_number() OVER (PARTITION BY doc ORDER BY p DESC, a DESC, page) AS w_r FROM (SELECT doc, page, round(p, 4) AS p, round(a, 4) AS a FROM r_)),
  g_ AS (SELECT doc, count(*) AS pages, avg(p) AS pm, {_top("p")} AS pt, max(p) AS pp, avg(a) AS am, {_top("a")} AS at_, max(a) AS ap, string_agg(CAST(page AS VARCHAR), ',' ORDER BY w_r) FILTER (w_r <= 3) AS worst FROM q_ GROUP BY doc)""",
  body="""SELECT doc, coalesce(pages, 0) AS pages, round(coalesce(pm, 0), 9) AS p_mean, round(coalesce(pt, 0), 9) AS p_top, round(coalesce(pp, 0), 9) AS p_peak, round(coalesce(total, 0), 4) AS total, round(coalesce(unattributed, 0), 4) AS unattributed,
  coalesce(n_unattributed, 0) AS n_unattributed, round(am, 9) AS a_mean, round(at_, 9) AS a_top, round(ap, 9) AS a_peak, worst FROM g_ FULL JOIN u_ USING (doc)"""))  # fmt: skip
def attribution_summary(t: Tables) -> DataFrame:
    """Means, worst 5 %, peaks, what is unattributed and the three worst pages of a document, by costs to four places."""
    rows, lost = page_rules.attributed(*cost_rows(t))
    s = page_rules.attribution_summary(rows.withColumns({"p": F.round("p", 4), "a": F.round("a", 4)}), lost)
    means = ["p_mean", "p_top", "p_peak", "a_mean", "a_top", "a_peak"]
    return s.select("doc", "pages", *[F.round(c, 9).alias(c) for c in means], *[F.round(c, 4).alias(c) for c in ("total", "unattributed")], "n_unattributed", F.array_join("worst", ",").alias("worst"))


@query("sample_anomalies", with_views(*VIEWS, body="""SELECT sample, venue, kind FROM (SELECT sample, s_.venue AS venue, unnest([CASE WHEN refs = 0 THEN 'refs_zero' END, CASE WHEN content_pages < 4 THEN 'content_pages_implausible' WHEN content_pages > page_limit_content + 6 THEN 'content_pages_over_limit' END,
  CASE WHEN fig_width_frac_median > 1.001 THEN 'fig_width_frac_gt_1' END, CASE WHEN s_.columns <> o_.columns THEN 'columns_mismatch' END, CASE WHEN CASE WHEN sample % 3 = 0 THEN 'a4' ELSE 'letter' END <> paper THEN 'paper_size_mismatch' END,
  CASE WHEN abs(body_font_pt - body_font_size_pt) > 1 THEN 'body_font_mismatch' END]) AS kind FROM s_ LEFT JOIN o_ ON o_.venue = s_.venue) WHERE kind IS NOT NULL"""))  # fmt: skip
def sample_anomalies(t: Tables) -> DataFrame:
    """Seven rules of measured samples against their venue's official values."""
    said = templates.latest_constraints(constraints(t))
    value = lambda k: F.col("official")[k]["value"]
    official = said.select("venue", value("page_limit_content").alias("page_limit"), value("columns").alias("columns"), F.col("official")["paper_size"]["text"].alias("paper"), value("body_font_size_pt").alias("font"))
    return page_rules.sample_anomalies(samples(t), official)
