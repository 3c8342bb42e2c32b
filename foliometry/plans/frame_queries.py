"""Queries of text frames: lines of pages, which stand-in rules make from lineitem, measured by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliometry.operators import frames
from foliometry.operators.lineage import cut
from foliometry.plans.registry import Tables, query, with_views

WIDTH, HEIGHT = 612.0, 792.0
#: Lines of 60 a page; odd documents have two columns of 30, those with number 9 modulo 10 with too small a gap.
LINES = r"""
ln_ AS (SELECT *, page % 5 = 0 AND k = 0 AND two AS across, CAST(CASE WHEN l_linenumber = 6 THEN 8.2 WHEN qty = 50 THEN 14.0 ELSE 10 + (disc % 3) * 0.1 END AS DOUBLE) AS size
 FROM (SELECT l_suppkey AS doc, n // 60 + 1 AS page, n % 60 AS k, l_suppkey % 2 = 1 AS two, l_linenumber, CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax, CAST(l_quantity AS BIGINT) AS qty
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS n FROM lineitem))),
ll_ AS (SELECT doc, page, size, 5 + qty AS nchars, l_linenumber = 5 AND disc < 3 AS fig,
 CASE WHEN across THEN 50 + doc % 4 ELSE CASE WHEN two AND k >= 30 THEN 310 + doc % 7 ELSE 50 + doc % 4 END + CASE WHEN l_linenumber = 7 THEN 14 WHEN disc = 0 THEN 0.4 ELSE 0 END END::DOUBLE AS x0,
 CASE WHEN across THEN 560 ELSE CASE WHEN two AND k < 30 THEN 302 + doc % 7 - CASE WHEN doc % 10 = 9 THEN -6 ELSE doc % 3 END ELSE 560 END - CASE WHEN tax = 0 THEN 30 + qty WHEN tax = 1 THEN 0.6 ELSE 0 END END::DOUBLE AS x1,
 (CASE WHEN two THEN 740 - 22 * (k % 30) ELSE 740 - 11 * k END)::DOUBLE AS y1, CASE WHEN two THEN 740 - 22 * (k % 30) ELSE 740 - 11 * k END - size AS y0 FROM ln_)"""
SNAP = "coalesce(list_filter([7.0, 8.0, 9.0, 10.0, 11.0, 12.0], lambda s: abs(size - s) <= 0.6)[1], round(size, 1))"
FRAME = f"""
bo_ AS MATERIALIZED (SELECT *, NOT fig OR bool_and(fig) OVER (PARTITION BY doc) AS txt, {SNAP} AS snap FROM (SELECT l.* FROM ll_ l JOIN (SELECT doc, min(page) AS p0, max(page) AS p1 FROM ll_ GROUP BY doc) p ON p.doc = l.doc WHERE page > p0 OR p0 = p1)),
pt_ AS (SELECT doc, snap AS body_pt FROM (SELECT doc, snap, row_number() OVER (PARTITION BY doc ORDER BY sum(nchars) DESC, snap) AS r FROM bo_ WHERE txt GROUP BY doc, snap) WHERE r = 1),
la_ AS (SELECT b.*, body_pt, size >= body_pt - 0.6 AS large FROM bo_ b JOIN pt_ USING (doc)),
ma_ AS MATERIALIZED (SELECT * FROM (SELECT *, bool_or(large) FILTER (WHERE txt) OVER (PARTITION BY doc) AS has_large FROM la_) WHERE txt AND (large OR NOT has_large)),
ed_ AS (SELECT doc, min(x0) AS left_, max(x1) AS far, count(*) AS n FROM ma_ GROUP BY doc),
pk_ AS (SELECT doc, min(bin) AS peak FROM (SELECT doc, round_even(x0, 0) AS bin, count(*) AS c FROM ma_ GROUP BY 1, 2) JOIN ed_ USING (doc) WHERE c >= greatest(3, 0.05 * n) GROUP BY doc),
le_ AS MATERIALIZED (SELECT doc, left_, far, coalesce(peak, left_) AS p_left FROM ed_ LEFT JOIN pk_ USING (doc)),
pg_ AS (SELECT doc, page, count(*) AS n, max(x1) AS p_right FROM bo_ WHERE NOT fig GROUP BY 1, 2 HAVING count(*) >= 15),
xs_ AS (SELECT doc, page, n, p_left, p_right, unnest(range(CAST(floor(p_left) AS BIGINT), CAST(floor(p_right) AS BIGINT) + 1)) AS x FROM pg_ JOIN le_ USING (doc) WHERE floor(p_right) - floor(p_left) >= 120),
cv_ AS (SELECT x.doc, x.page, any_value(x.n) AS n, any_value(p_left) AS p_left, any_value(p_right) AS p_right, x.x, count(b.doc) AS cover FROM xs_ x LEFT JOIN bo_ b ON b.doc = x.doc AND b.page = x.page AND NOT b.fig AND floor(b.x0) <= x.x AND x.x <= floor(b.x1)
  AND least(floor(b.x1), floor(p_right)) > greatest(floor(b.x0), floor(p_left)) GROUP BY x.doc, x.page, x.x),
lo_ AS (SELECT *, x - row_number() OVER (PARTITION BY doc, page ORDER BY x) AS island FROM cv_ WHERE cover <= greatest(1, floor(0.05 * n))),
st_ AS (SELECT doc, page, any_value(p_left) AS p_left, any_value(p_right) AS p_right, min(x) AS s, max(x) + 1 AS e FROM lo_ GROUP BY doc, page, island),
be_ AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY e - s DESC, s) AS r FROM st_),
hi_ AS (SELECT doc, page, e AS g FROM be_ WHERE r = 1 AND e - s >= 6 AND s >= p_left + 0.25 * (p_right - p_left) AND e <= p_right - 0.15 * (p_right - p_left)),
cl_ AS (SELECT doc, g, sum(jump) OVER (PARTITION BY doc ORDER BY g, page ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, CASE WHEN g - lag(g) OVER (PARTITION BY doc ORDER BY g, page) > 6 THEN 1 ELSE 0 END AS jump FROM hi_)),
vo_ AS (SELECT doc, round(g, 1) AS gutter FROM (SELECT doc, c, count(*) AS n, quantile_cont(g, 0.5) AS g, sum(count(*)) OVER (PARTITION BY doc) AS votes, row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, c) AS r FROM cl_ GROUP BY doc, c) WHERE r = 1 AND n >= greatest(3, 0.3 * votes)),
md_ AS (SELECT doc, x1, 'whole' AS side FROM ma_ UNION ALL SELECT m.doc, x1, 'r1' FROM ma_ m JOIN vo_ v ON v.doc = m.doc WHERE x1 <= gutter - 2 UNION ALL SELECT m.doc, x1, 'r2' FROM ma_ m JOIN vo_ v ON v.doc = m.doc WHERE x0 >= gutter - 2),
mo_ AS (SELECT doc, side, bin FROM (SELECT doc, side, round_even(x1, 0) AS bin, row_number() OVER (PARTITION BY doc, side ORDER BY count(*) DESC, round_even(x1, 0)) AS r FROM md_ GROUP BY 1, 2, 3) WHERE r = 1),
mm_ AS (SELECT doc, max(x) FILTER (WHERE side = 'whole') AS whole, max(x) FILTER (WHERE side = 'r1') AS r1, max(x) FILTER (WHERE side = 'r2') AS r2 FROM (SELECT d.doc, d.side, round(avg(x1), 1) AS x FROM md_ d JOIN mo_ o ON o.doc = d.doc AND o.side = d.side AND abs(x1 - bin) <= 1 GROUP BY 1, 2) GROUP BY doc),
al_ AS (SELECT l.doc, left_, p_left, far, gutter, whole, coalesce(m.r1, gutter) AS r1, coalesce(m.r2, 612 - left_) AS r2 FROM le_ l LEFT JOIN vo_ v ON v.doc = l.doc LEFT JOIN mm_ m ON m.doc = l.doc),
tw_ AS (SELECT *, coalesce(round(gutter - r1, 1) BETWEEN 4 AND 60 AND r2 - gutter >= 40, FALSE) AS two FROM al_),
tb_ AS (SELECT doc, round(quantile_cont(t, 0.5), 3) AS t, round(quantile_cont(b, 0.5), 3) AS b FROM (SELECT doc, page, max(y1) AS t, min(y0) AS b FROM la_ WHERE large GROUP BY 1, 2) GROUP BY doc),
fr_ AS MATERIALIZED (SELECT w.doc, left_, p_left, CASE WHEN two THEN greatest(r1, r2) ELSE coalesce(whole, far) END AS right_, coalesce(t, 792) AS top, coalesce(b, 0) AS bottom, CASE WHEN two THEN 2 ELSE 1 END AS columns, CASE WHEN two THEN gutter END AS gutter,
  CASE WHEN two THEN round(gutter - r1, 1) END AS col_gap, CASE WHEN two THEN r1 ELSE coalesce(whole, far) END AS r1, r2, body_pt, greatest(1, coalesce(t, 792) - coalesce(b, 0)) AS tall FROM tw_ w LEFT JOIN tb_ USING (doc) JOIN pt_ USING (doc)),
frame_ AS MATERIALIZED (SELECT doc, round(left_, 2) AS left, round(p_left, 2) AS p_left, round(right_, 2) AS right, round(top, 2) AS top, round(bottom, 2) AS bottom, columns, round(gutter, 2) AS gutter, round(col_gap, 2) AS col_gap, round(r1, 2) AS col1_right, round(gutter, 2) AS col2_left,
  round(CASE WHEN columns = 2 THEN (r1 - left_ + r2 - gutter) / 2 ELSE right_ - left_ END, 2) AS col_width, round(body_pt, 2) AS body_pt, round(tall, 2) AS height_pt, round(CASE WHEN columns = 2 THEN r1 - left_ + r2 - gutter ELSE right_ - left_ END * tall, 1) AS usable_pt2 FROM fr_)"""


def page_lines(t: Tables) -> DataFrame:
    """Stand-in lines of pages: doc, page, x0, x1, y0, y1, size, nchars, fig, text (all but the text in the view ll_ of the SQL)."""
    order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    n = F.row_number().over(order) - 1
    x = t["lineitem"].select(
        F.col("l_suppkey").alias("doc"), F.floor(n / 60).alias("p"), (n % 60).alias("k"), "l_linenumber", F.round(F.col("l_discount") * 100).cast("long").alias("disc"),
        F.round(F.col("l_tax") * 100).cast("long").alias("tax"), F.col("l_quantity").cast("long").alias("qty"),
    )
    doc, k, line = F.col("doc"), F.col("k"), F.col("l_linenumber")
    page, two = F.col("p") + 1, doc % 2 == 1
    across = (page % 5 == 0) & (k == 0) & two
    left, second = 50 + doc % 4, two & (k >= 30)
    size = F.when(line == 6, 8.2).when(F.col("qty") == 50, 14.0).otherwise(10 + (F.col("disc") % 3) * 0.1)
    indent = F.when(line == 7, 14.0).when(F.col("disc") == 0, 0.4).otherwise(0.0)
    edge = F.when(two & (k < 30), 302 + doc % 7 - F.when(doc % 10 == 9, -6).otherwise(doc % 3)).otherwise(560)
    short = F.when(F.col("tax") == 0, 30.0 + F.col("qty")).when(F.col("tax") == 1, 0.6).otherwise(0.0)
    y1 = F.when(two, 740 - 22 * (k % 30)).otherwise(740 - 11 * k).cast("double")
    shown = page.cast("string")
    text = F.when(k.isin(10, 40) & (page % 3 == 0), F.concat(F.lit("Figure "), shown, F.lit(": caption"))).when((k == 0) & (page % 5 == 0), F.concat(F.lit("Table "), shown, F.lit(". wide"))).when((k >= 25) & (line == 6), "1 note").otherwise("words")
    return x.select(
        "doc", page.alias("page"), F.when(across, left).otherwise(F.when(second, 310 + doc % 7).otherwise(left) + indent).cast("double").alias("x0"), F.when(across, 560).otherwise(edge - short).cast("double").alias("x1"), (y1 - size).alias("y0"),
        y1.alias("y1"), size.alias("size"), (5 + F.col("qty")).alias("nchars"), ((line == 5) & (F.col("disc") < 3)).alias("fig"), text.alias("text"),
    )


@query("frame_measure", with_views(LINES, FRAME, body="SELECT * FROM frame_"))
def frame_measure(t: Tables) -> DataFrame:
    """Body size, left peak, columns and gutter, right edge, top and bottom of each document."""
    return frames.frames(cut(page_lines(t)), WIDTH, HEIGHT)


@query("alignment_metrics", with_views(LINES, FRAME, r"""co_ AS (SELECT doc, body_pt, unnest(CASE WHEN columns = 2 THEN [{'k': 0, 'a': "left", 'b': col1_right}, {'k': 1, 'a': col2_left, 'b': "right"}] ELSE [{'k': 0, 'a': "left", 'b': "right"}] END) AS c FROM frame_),
is_ AS (SELECT l.*, c.k, c.a, c.b, x1 >= c.b - 2 AND nchars >= 8 AS is_full, x1 < c.b - 8 AS is_short FROM ll_ l JOIN co_ ON co_.doc = l.doc WHERE nchars >= 3 AND NOT fig AND size >= body_pt - 0.6 AND x0 >= c.a - 2 AND x1 <= c.b + 2),
by_ AS (SELECT doc, page, k, CASE WHEN count_if(is_full) >= 2 THEN round(stddev_pop(x0 - a) FILTER (WHERE is_full), 3) END AS l, CASE WHEN count_if(is_full) >= 2 THEN round(stddev_pop(b - x1) FILTER (WHERE is_full), 3) END AS r,
 CASE WHEN count_if(is_short) >= 2 THEN round(stddev_pop((x0 + x1) / 2 - (a + b) / 2) FILTER (WHERE is_short), 3) END AS c, count_if(is_full) AS nf, count_if(is_short) AS ns, count(*) AS n FROM is_ GROUP BY doc, page, k)""",
 body="SELECT doc, page, round(quantile_cont(l, 0.5), 4) AS left_var, round(quantile_cont(r, 0.5), 4) AS right_var, round(quantile_cont(c, 0.5), 4) AS center_var, sum(nf)::BIGINT AS n_full, sum(ns)::BIGINT AS n_short, sum(n)::BIGINT AS n_lines FROM by_ GROUP BY doc, page"))
def alignment_metrics(t: Tables) -> DataFrame:
    """Spread of the edges of full lines and of the centres of short ones, by page."""
    lines = cut(page_lines(t))
    return frames.alignment(lines, cut(frames.frames(lines, WIDTH, HEIGHT)))


@query("margin_measure")
def margin_measure(t: Tables) -> DataFrame:
    """Margins, text size, captions by size, alignment and place, footnotes of each document."""
    lines = cut(page_lines(t))
    return frames.margins(lines, cut(frames.frames(lines, WIDTH, HEIGHT)), WIDTH, HEIGHT)
