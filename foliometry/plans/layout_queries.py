"""Queries of page geometry: cells, balance, alignment, boxes, blank regions. Boxes come from orders by rule (items)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliometry.functions.scalar import r6
from foliometry.operators import geometry
from foliometry.plans.join_queries import ITEMS, items
from foliometry.plans.registry import PAGES_SQL, Tables, query, with_views

CELLS = """cell_ AS (SELECT DISTINCT doc, i, j FROM (SELECT doc, unnest(range(CAST(floor(x0 / 20) AS BIGINT), CAST(ceil(x1 / 20) AS BIGINT))) AS i, y0, y1 FROM item_) t, LATERAL (SELECT unnest(range(CAST(floor(t.y0 / 20) AS BIGINT), CAST(ceil(t.y1 / 20) AS BIGINT))) AS j))"""


def cells(t: Tables) -> DataFrame:
    return geometry.cells(items(t), ["doc"], 20.0)


@query("grid_coverage", with_views(ITEMS, CELLS, body="SELECT doc, count(*) AS covered, round(count(*) / (29.0 * 38.0), 6) AS share FROM cell_ GROUP BY doc"))
def grid_coverage(t: Tables) -> DataFrame:
    """Distinct grid cells under boxes, and their share of the frame."""
    return cells(t).groupBy("doc").agg(F.count("*").alias("covered"), r6(F.count("*") / (29.0 * 38.0)).alias("share"))


@query("balance_metrics", with_views(ITEMS, CELLS, body="SELECT doc, round(avg(CASE WHEN j < 13 THEN 1.0 ELSE 0.0 END), 6) AS top, round(avg(CASE WHEN j >= 13 AND j < 26 THEN 1.0 ELSE 0.0 END), 6) AS middle, round(avg(CASE WHEN j >= 26 THEN 1.0 ELSE 0.0 END), 6) AS bottom, round(avg(j + 0.5), 6) AS centroid, round(avg(CASE WHEN i < 14 THEN 1.0 ELSE 0.0 END), 6) AS left_share FROM cell_ GROUP BY doc"))
def balance_metrics(t: Tables) -> DataFrame:
    share = lambda c: r6(F.avg(F.when(c, 1.0).otherwise(0.0)))
    j = F.col("j")
    return cells(t).groupBy("doc").agg(share(j < 13).alias("top"), share((j >= 13) & (j < 26)).alias("middle"), share(j >= 26).alias("bottom"), r6(F.avg(j + 0.5)).alias("centroid"), share(F.col("i") < 14).alias("left_share"))


@query("box_alignment", with_views(ITEMS, body="SELECT doc, round(quantile_cont(l, 0.5), 6) AS left_sd, round(quantile_cont(r, 0.5), 6) AS right_sd FROM (SELECT doc, CAST(floor(x0 / 280) AS BIGINT) AS col, stddev_pop(x0) AS l, stddev_pop(x1) AS r FROM item_ GROUP BY 1, 2) GROUP BY doc"))
def box_alignment(t: Tables) -> DataFrame:
    """Spread of the edges within columns, median over columns."""
    g = items(t).groupBy("doc", F.floor(F.col("x0") / 280).alias("col")).agg(F.stddev_pop("x0").alias("l"), F.stddev_pop("x1").alias("r"))
    return g.groupBy("doc").agg(r6(F.percentile("l", 0.5)).alias("left_sd"), r6(F.percentile("r", 0.5)).alias("right_sd"))


@query("float_quality", with_views(ITEMS, body="SELECT doc, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN stddev_pop(y1 - y0) / avg(y1 - y0) END, 6) AS height_cv, round(min(72 * 600 / (x1 - x0)), 6) AS min_dpi, count(*) FILTER (WHERE abs((x1 - x0) / (y1 - y0) / 2.7 - 1) > 0.1) AS stretched FROM item_ GROUP BY doc"))
def float_quality(t: Tables) -> DataFrame:
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return items(t).groupBy("doc").agg(F.count("*").alias("n"), r6(F.when(F.count("*") >= 2, F.stddev_pop(h) / F.avg(h))).alias("height_cv"), r6(F.min(72 * 600 / w)).alias("min_dpi"), F.count_if(F.abs(w / h / 2.7 - 1) > 0.1).alias("stretched"))


@query("box_frame", with_views(ITEMS, body="SELECT doc, min(x0) AS left_edge, max(x1) AS right_edge, min(y0) AS top, max(y1) AS bottom, count(DISTINCT CAST(floor(x0 / 280) AS BIGINT)) AS columns FROM item_ GROUP BY doc"))
def box_frame(t: Tables) -> DataFrame:
    return items(t).groupBy("doc").agg(F.min("x0").alias("left_edge"), F.max("x1").alias("right_edge"), F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.count_distinct(F.floor(F.col("x0") / 280)).alias("columns"))


@query("box_margins", with_views(ITEMS, body="SELECT doc, round(min(x0) * 25.4 / 72, 6) AS left_mm, round((612 - max(x1)) * 25.4 / 72, 6) AS right_mm, round((max(x1) - min(x0)) * 25.4 / 72, 6) AS width_mm FROM item_ GROUP BY doc"))
def box_margins(t: Tables) -> DataFrame:
    mm = lambda c: r6(c * 25.4 / 72)
    return items(t).groupBy("doc").agg(mm(F.min("x0")).alias("left_mm"), mm(612 - F.max("x1")).alias("right_mm"), mm(F.max("x1") - F.min("x0")).alias("width_mm"))


@query("math_density", "SELECT source, round(sum(len(regexp_extract_all(text, '[0-9]'))) / sum(length(text)), 9) AS density FROM documents GROUP BY source")
def math_density(t: Tables) -> DataFrame:
    n = F.length("text")
    return t["documents"].groupBy("source").agg(F.round(F.sum(F.regexp_count("text", F.lit("[0-9]"))) / F.sum(n), 9).alias("density"))


NEAR = "near_ AS (SELECT a.doc, a.id AS a, b.id AS b FROM item_ a JOIN item_ b ON a.doc = b.doc AND a.x0 - 8 <= b.x1 AND b.x0 - 8 <= a.x1 AND a.y0 - 8 <= b.y1 AND b.y0 - 8 <= a.y1)"


@query("merge_boxes", "WITH RECURSIVE " + ITEMS + ", " + NEAR + ", reach_(doc, a, b) AS (SELECT doc, a, b FROM near_ UNION SELECT r.doc, r.a, n.b FROM reach_ r JOIN near_ n ON r.doc = n.doc AND r.b = n.a), lab_ AS (SELECT doc, a AS id, min(b) AS box FROM reach_ GROUP BY 1, 2) SELECT doc, box, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM lab_ JOIN item_ USING (doc, id) GROUP BY doc, box")
def merge_boxes(t: Tables) -> DataFrame:
    """Boxes closer than 8 pt joined to one."""
    return geometry.merged_boxes(items(t), "doc", 8.0)


@query("covered_rows", with_views(ITEMS, CELLS, body="SELECT doc, j, CASE WHEN n = 0 THEN 'band' WHEN j >= last THEN 'trailing' WHEN n < 4 THEN 'anomalous' ELSE 'structural' END AS class FROM (SELECT doc, j, count(*) AS n, max(j) OVER (PARTITION BY doc) AS last FROM cell_ GROUP BY doc, j)"))
def whitespace_class(t: Tables) -> DataFrame:
    """Class of each grid row by what covers it, in a fixed order of decisions."""
    rows = cells(t).groupBy("doc", "j").agg(F.count("*").alias("n")).withColumn("last", F.max("j").over(W.partitionBy("doc")))
    return rows.select("doc", "j", F.when(F.col("n") == 0, "band").when(F.col("j") >= F.col("last"), "trailing").when(F.col("n") < 4, "anomalous").otherwise("structural").alias("class"))


GRID = geometry.Grid(29, 38, 20.0)
LEADING = 45.0
FRAME = "frame_ AS (SELECT doc, j FROM (SELECT DISTINCT doc FROM item_), (SELECT unnest(range(0, 38)) AS j))"


def regions(t: Tables) -> DataFrame:
    """Blank regions of all pages over the full frame; a box's kind comes from the order's priority by rule."""
    kind = F.when(F.col("o_orderpriority").startswith("1"), "head").when(F.col("o_orderpriority").startswith("2"), "float").when(F.col("o_orderpriority").startswith("3"), "caption").otherwise("text")
    boxes = items(t).join(t["orders"].select(F.col("o_orderkey").alias("id"), kind.alias("kind")), "id")
    context = boxes.select("doc").distinct().select("doc", (F.col("doc") % 10 == 0).alias("is_first"), (F.col("doc") % 10 == 9).alias("is_last"))  # ten pages a document
    return geometry.blank_regions(boxes, "doc", "kind", GRID, LEADING, context)


@query("blank_regions")
def blank_regions_all(t: Tables) -> DataFrame:
    """Connected blank cells of every page and every cell of its frame, with bands; regions under 0.4% are marked."""
    return regions(t).select("doc", "region", "n_cells", "top", "bottom", "band", "bottom_band", "fragment")


@query("whitespace_class")
def whitespace_regions(t: Tables) -> DataFrame:
    """Class and confidence of every blank region."""
    return regions(t).select("doc", "region", "n_cells", "rule", "class", "confidence")


@query("whitespace_ratios")
def whitespace_ratios(t: Tables) -> DataFrame:
    """Blank share of every page's frame and its five parts by class; a page without blank cells has zeros."""
    share = lambda c: F.sum(F.when(c, F.col("n_cells")).otherwise(0)) / GRID.cells
    parts = [share(F.col("class") == c) for c in geometry.CLASSES]
    found = regions(t).groupBy("doc").agg(share(F.lit(True)).alias("total"), *[p.alias(c) for p, c in zip(parts, geometry.CLASSES, strict=True)])
    names = ["total", *geometry.CLASSES]
    return items(t).select("doc").distinct().join(found, "doc", "left").select("doc", *[r6(F.coalesce(c, F.lit(0.0))).alias(c) for c in names])


@query("whitespace_rows", with_views(ITEMS, CELLS, FRAME, body="SELECT doc, j, CASE WHEN n = 0 THEN 'band' WHEN j >= last THEN 'trailing' WHEN n < 4 THEN 'anomalous' ELSE 'structural' END AS class FROM (SELECT f.doc, f.j, count(c.i) AS n, max(CASE WHEN count(c.i) > 0 THEN f.j END) OVER (PARTITION BY f.doc) AS last FROM frame_ f LEFT JOIN cell_ c ON c.doc = f.doc AND c.j = f.j GROUP BY f.doc, f.j)"))
def whitespace_rows(t: Tables) -> DataFrame:
    """Class of each row of every page's frame, wholly blank ones too, by what covers it."""
    covered = geometry.row_masks(items(t).withColumn("kind", F.lit("box")), "doc", "kind", GRID).where("row is not null")
    frame = items(t).select("doc").distinct().select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GRID.rows - 1).cast("long"))).alias("j"))
    rows = frame.join(covered.select("doc", F.col("row").alias("j"), F.bit_count("mask").alias("n")), ["doc", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.withColumn("last", F.max(F.when(F.col("n") > 0, F.col("j"))).over(W.partitionBy("doc")))
    return rows.select("doc", "j", F.when(F.col("n") == 0, "band").when(F.col("j") >= F.col("last"), "trailing").when(F.col("n") < 4, "anomalous").otherwise("structural").alias("class"))


FLOATS = """box_ AS (SELECT o_custkey AS page, o_orderkey AS id, substr(o_orderpriority, 1, 1) AS kind, CAST(o_orderkey % 13 AS DOUBLE) * 40 AS x0, CAST(o_orderkey % 17 AS DOUBLE) * 45 AS y0,
  CAST(o_orderkey % 13 AS DOUBLE) * 40 + 60 AS x1, CAST(o_orderkey % 17 AS DOUBLE) * 45 + 20 + o_orderkey % 5 AS y1 FROM orders),
cap_ AS (SELECT *, CASE WHEN x0 >= 276 THEN 280.0 ELSE 0.0 END AS lft, CASE WHEN x0 >= 276 THEN 580.0 ELSE 260.0 END AS rgt FROM box_ WHERE kind = '3'),
g_ AS (SELECT * FROM box_ WHERE kind IN ('1', '2') AND (x1 - x0) * (y1 - y0) < 0.75 * 440800 AND x1 - x0 >= 12 AND y1 - y0 >= 3 AND (x1 - x0) * (y1 - y0) >= 0.004 * 300000),
reach_ AS (SELECT c.id, c.page, c.lft, c.rgt, greatest(c.x0, c.lft) AS x0, greatest(c.y0, 40.0) AS y0, least(c.x1, c.rgt) AS x1, least(c.y1, 740.0) AS y1 FROM cap_ c
  UNION SELECT r.id, r.page, r.lft, r.rgt, greatest(g.x0, r.lft), greatest(g.y0, 40.0), least(g.x1, r.rgt), least(g.y1, 740.0) FROM reach_ r JOIN g_ g ON g.page = r.page AND least(g.x1, r.rgt) - greatest(g.x0, r.lft) >= 2 AND g.y1 >= r.y0 - 60 AND g.y0 <= r.y1 + 60)"""


@query("float_regions", "WITH RECURSIVE " + FLOATS + " SELECT page, id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round((max(x1) - min(x0)) * (max(y1) - min(y0)), 1) AS area FROM reach_ GROUP BY page, id")
def float_regions(t: Tables) -> DataFrame:
    """Regions that captions span with the graphics of their column, chained by gaps of at most 60."""
    o = t["orders"]
    x, y = (F.col("o_orderkey") % 13).cast("double") * 40, (F.col("o_orderkey") % 17).cast("double") * 45
    boxes = o.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).alias("kind"), x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 20 + F.col("o_orderkey") % 5).alias("y1"))
    second = F.col("x0") >= 276
    captions = boxes.where("kind = '3'").select("*", F.when(second, 280.0).otherwise(0.0).alias("left"), F.when(second, 580.0).otherwise(260.0).alias("right"), F.lit(40.0).alias("bottom"), F.lit(740.0).alias("top"))
    graphics = geometry.usable_graphics(boxes.where("kind in ('1', '2')"), 440800.0, 300000.0)
    out = geometry.float_regions(captions, graphics, "page", 60.0)
    return out.select("page", "id", "x0", "y0", "x1", "y1", F.round((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), 1).alias("area"))
