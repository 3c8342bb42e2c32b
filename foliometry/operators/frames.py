"""The text frame of documents from their lines: body size, left edge, columns by a vote of pages, right edges, top and bottom.

A document's lines are (doc, page, x0, x1, y0, y1, size, nchars, fig). Histograms are counts before any join, the blank
stretches of a page are a sweep over its line ends, and what documents learn about themselves is joined back by document.

Defined results: the first page is left out where there are others; lines in figures count only where a document has no others;
of equally frequent values the smallest is taken, of equally long stretches and equally large clusters the first; documents
without lines have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliometry.functions.scalar import snap_size
from foliometry.operators.lineage import cut

#: Lines that a page must have to vote, width that it must have, blank stretch that counts, reach of a cluster.
LEAST_LINES, LEAST_WIDTH, LEAST_GUTTER, REACH = 15, 120, 6, 6
#: Share of lines of a peak or across a gutter, where a gutter may lie, share of pages, slack of body size.
SHARE, FROM_LEFT, FROM_RIGHT, VOTES, SLACK = 0.05, 0.25, 0.15, 0.3, 0.6
#: Widths between columns, and the least width of the second column.
GAP, LEAST_COLUMN = (4.0, 60.0), 40.0


def _most(df: DataFrame, key: list[str], value: str, weight: Column) -> DataFrame:
    """The value with the largest sum of weights for each key, the smallest of several."""
    sums = df.groupBy(*key, value).agg(weight.alias("__w"))
    return sums.groupBy(*key).agg(F.max(F.struct("__w", (-F.col(value)).alias("v"))).alias("b")).select(*key, (-F.col("b.v")).alias(value))


def edge_mode(df: DataFrame, value: str, out: str) -> DataFrame:
    """For each doc the mean of the values within 1 of the most frequent whole number, to one decimal."""
    binned = df.select("doc", F.col(value).alias("v"), F.bround(value).alias("bin"))
    near = binned.select("doc", "v").join(_most(binned, ["doc"], "bin", F.count("*")), "doc").where(F.abs(F.col("v") - F.col("bin")) <= 1)
    return near.groupBy("doc").agg(F.round(F.avg("v"), 1).alias(out))


def _body(lines: DataFrame) -> DataFrame:
    """Lines of the pages that count, with whether a line counts as text."""
    known = lines.groupBy("doc").agg(F.min("page").alias("p0"), F.max("page").alias("p1"))
    rest = lines.join(known, "doc").where((F.col("page") > F.col("p0")) | (F.col("p0") == F.col("p1"))).drop("p0", "p1")
    bare = rest.groupBy("doc").agg(F.bool_and("fig").alias("__only"))
    return rest.join(bare, "doc").withColumn("text", ~F.col("fig") | F.col("__only")).drop("__only")


def gutters(lines: DataFrame, left: DataFrame) -> DataFrame:
    """The right end of the widest blank stretch of each page that may part columns: doc, page, gutter.

    lines: those outside figures; left: doc and p_left. Coverage changes only where a line begins or ends.
    """
    pages = lines.groupBy("doc", "page").agg(F.count("*").alias("n"), F.max("x1").alias("p_right")).where(F.col("n") >= LEAST_LINES).join(left, "doc")
    pages = pages.withColumn("lo", F.floor("p_left")).withColumn("hi", F.floor("p_right")).where(F.col("hi") - F.col("lo") >= LEAST_WIDTH)
    ends = lines.select("doc", "page", "x0", "x1").join(pages.select("doc", "page", "lo", "hi"), ["doc", "page"])
    ends = ends.select("doc", "page", F.greatest("lo", F.floor("x0")).alias("a"), F.least("hi", F.floor("x1")).alias("b")).where("b > a")
    step = lambda x, d: F.struct(x.alias("x"), F.lit(d).alias("d"))
    events = ends.select("doc", "page", F.explode(F.array(step(F.col("a"), 1), step(F.col("b") + 1, -1))).alias("e"))
    edges = pages.select("doc", "page", F.explode(F.array(step(F.col("lo"), 0), step(F.col("hi") + 1, 0))).alias("e"))
    order = W.partitionBy("doc", "page").orderBy("x")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    net = events.union(edges).groupBy("doc", "page", F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    steps = net.select("doc", "page", "x", F.lead("x").over(order).alias("to"), F.sum("d").over(upto).alias("cover")).where("to is not null").join(pages, ["doc", "page"])
    low = F.col("cover") <= F.greatest(F.lit(1), F.floor(SHARE * F.col("n")))
    runs = steps.withColumn("low", low).withColumn("run", F.sum(F.when(~low, 1).otherwise(0)).over(upto)).where("low")
    found = runs.groupBy("doc", "page", "p_left", "p_right", "run").agg(F.min("x").alias("start"), F.max("to").alias("end"))
    best = found.groupBy("doc", "page", "p_left", "p_right").agg(F.max(F.struct((F.col("end") - F.col("start")).alias("wide"), (-F.col("start")).alias("s"), "end")).alias("b"))
    span = F.col("p_right") - F.col("p_left")
    wide = (F.col("b.wide") >= LEAST_GUTTER) & (-F.col("b.s") >= F.col("p_left") + FROM_LEFT * span) & (F.col("b.end") <= F.col("p_right") - FROM_RIGHT * span)
    return best.where(wide).select("doc", "page", F.col("b.end").cast("double").alias("gutter"))


def vote(hits: DataFrame) -> DataFrame:
    """The gutter that most pages of a document agree on: the median of the largest cluster, if it has 3 and 30 % of the pages' votes."""
    order = W.partitionBy("doc").orderBy("gutter")
    apart = F.coalesce(F.col("gutter") - F.lag("gutter").over(order) > REACH, F.lit(False))
    clustered = hits.withColumn("new", apart).withColumn("cluster", F.sum(F.col("new").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    sizes = clustered.groupBy("doc", "cluster").agg(F.count("*").alias("n"), F.percentile("gutter", 0.5).alias("gutter"))
    best = sizes.groupBy("doc").agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("cluster")).alias("c"), "gutter")).alias("b"))
    return best.where((F.col("b.n") >= 3) & (F.col("b.n") >= VOTES * F.col("all"))).select("doc", F.round("b.gutter", 1).alias("gutter"))


def frames(lines: DataFrame, width: float, height: float) -> DataFrame:
    """One row a document: left, right, top, bottom, columns, gutter, col_gap, col1_right, col2_left, col_width, body_pt, height_pt, p_left, usable_pt2.

    width and height: the page's in points.
    """
    body = cut(_body(lines))
    sized = body.where("text").select("doc", "nchars", snap_size(F.col("size")).alias("body_pt"))
    body_pt = cut(_most(sized, ["doc"], "body_pt", F.sum("nchars")))
    main = body.join(body_pt, "doc").withColumn("large", F.col("size") >= F.col("body_pt") - SLACK)
    has = main.where("text").groupBy("doc").agg(F.bool_or("large").alias("__any"))
    main = cut(main.join(has, "doc").withColumn("main", F.col("text") & (F.col("large") | ~F.col("__any"))))
    kept = main.where("main")
    edges = kept.groupBy("doc").agg(F.min("x0").alias("left"), F.count("*").alias("n"), F.max("x1").alias("far"))
    bins = kept.groupBy("doc", F.bround("x0").alias("bin")).agg(F.count("*").alias("c")).join(edges, "doc")
    peaks = bins.where(F.col("c") >= F.greatest(F.lit(3.0), SHARE * F.col("n"))).groupBy("doc").agg(F.min("bin").alias("peak"))
    edges = cut(edges.join(peaks, "doc", "left").select("doc", "left", "far", F.coalesce("peak", "left").alias("p_left")))
    voted = cut(vote(gutters(body.where("not fig"), edges.select("doc", "p_left"))))
    by = kept.join(voted, "doc")
    sides = {}
    for side, inside in (("r1", F.col("x1") <= F.col("gutter") - 2), ("r2", F.col("x0") >= F.col("gutter") - 2)):
        sides[side] = edge_mode(by.where(inside), "x1", side)
    out = edges.join(voted, "doc", "left").join(edge_mode(kept, "x1", "whole"), "doc", "left").join(sides["r1"], "doc", "left").join(sides["r2"], "doc", "left")
    r1, r2 = F.coalesce("r1", "gutter"), F.coalesce(F.col("r2"), F.lit(width) - F.col("left"))
    gap = F.round(F.col("gutter") - r1, 1)
    two = F.col("gutter").isNotNull() & gap.between(*GAP) & (r2 - F.col("gutter") >= LEAST_COLUMN)
    whole = F.coalesce("whole", "far")
    out = out.select("doc", "left", "p_left", two.alias("two"), F.when(two, F.col("gutter")).alias("gutter"), F.when(two, gap).alias("col_gap"), F.when(two, F.greatest(r1, r2)).otherwise(whole).alias("right"), F.when(two, r1).otherwise(whole).alias("r1"), F.when(two, r2).otherwise(whole).alias("r2"))
    rows = main.where("large").groupBy("doc", "page").agg(F.max("y1").alias("t"), F.min("y0").alias("b"))
    ends = rows.groupBy("doc").agg(F.round(F.percentile("t", 0.5), 3).alias("t"), F.round(F.percentile("b", 0.5), 3).alias("b"))
    out = out.join(ends, "doc", "left").join(body_pt, "doc")
    top, bottom = F.coalesce("t", F.lit(height)), F.coalesce("b", F.lit(0.0))
    tall = F.greatest(F.lit(1.0), top - bottom)
    first, second = F.col("r1") - F.col("left"), F.col("r2") - F.col("gutter")
    wide = F.when(F.col("two"), (first + second) / 2).otherwise(F.col("right") - F.col("left"))
    used = F.when(F.col("two"), first + second).otherwise(F.col("right") - F.col("left"))
    cols = {
        "left": F.col("left"), "p_left": F.col("p_left"), "right": F.col("right"), "top": top, "bottom": bottom, "columns": F.when(F.col("two"), 2).otherwise(1), "gutter": F.col("gutter"), "col_gap": F.col("col_gap"),
        "col1_right": F.col("r1"), "col2_left": F.col("gutter"), "col_width": wide, "body_pt": F.col("body_pt"), "height_pt": tall, "usable_pt2": used * tall,
    }
    return out.select("doc", *[(c if name == "columns" else F.round(c, 1 if name == "usable_pt2" else 2)).alias(name) for name, c in cols.items()])


def alignment(lines: DataFrame, frame: DataFrame, pages: list[str] = ["page"]) -> DataFrame:  # noqa: B006
    """Spread of edges for each page: left and right edge of full lines, centre of short ones, by column, median over columns.

    Full lines reach the column's right edge; short ones end 8 pt before it. Also the number of both, and of lines in columns.
    """
    col = lambda k, a, b: F.struct(F.lit(k).alias("k"), a.alias("a"), b.alias("b"))
    both = F.array(col(0, F.col("left"), F.col("col1_right")), col(1, F.col("col2_left"), F.col("right")))
    one = F.array(col(0, F.col("left"), F.col("right")))
    columns = frame.select("doc", "body_pt", F.explode(F.when(F.col("columns") == 2, both).otherwise(one)).alias("c")).select("doc", "body_pt", "c.*")
    inside = lines.where((F.col("nchars") >= 3) & ~F.col("fig")).join(columns, "doc").where((F.col("size") >= F.col("body_pt") - SLACK) & (F.col("x0") >= F.col("a") - 2) & (F.col("x1") <= F.col("b") + 2))
    full, short = (F.col("x1") >= F.col("b") - 2) & (F.col("nchars") >= 8), F.col("x1") < F.col("b") - 8
    sd = lambda cond, x: F.when(F.count_if(cond) >= 2, F.round(F.stddev_pop(F.when(cond, x)), 3))
    by = inside.groupBy("doc", *pages, "k").agg(
        sd(full, F.col("x0") - F.col("a")).alias("l"), sd(full, F.col("b") - F.col("x1")).alias("r"), sd(short, (F.col("x0") + F.col("x1")) / 2 - (F.col("a") + F.col("b")) / 2).alias("c"),
        F.count_if(full).alias("n_full"), F.count_if(short).alias("n_short"), F.count("*").alias("n"),
    )
    middle = lambda x: F.round(F.percentile(x, 0.5), 4)  # noqa: E731  of two columns the mean, which needs one place more
    return by.groupBy("doc", *pages).agg(middle("l").alias("left_var"), middle("r").alias("right_var"), middle("c").alias("center_var"), F.sum("n_full").alias("n_full"), F.sum("n_short").alias("n_short"), F.sum("n").alias("n_lines"))


CAPTION = r"^\s*(?i:(?:fig(?:ure|\.)?|tab(?:le|\.)?))\s*[0-9]+"
FOOTNOTE = r"^\s*(?:[0-9]{1,2}|[*†‡§])\s*\S"


def margins(lines: DataFrame, frame: DataFrame, width: float, height: float) -> DataFrame:
    """Of each document: margins in points, text width and height in mm, captions, footnotes.

    Captions: number, most frequent size (the smallest of several), how many begin at the column's left edge and how many do
    not, and for two columns the captions across both by where they stand on their page. Footnotes are marked small lines in
    the lowest quarter. lines has text as well.
    """
    body = _body(lines.withColumnRenamed("text", "words"))
    pages = body.groupBy("doc", "page").agg(F.max("y1").alias("y_top"), F.min("y0").alias("y_low"))
    ends = pages.groupBy("doc").agg(F.round(F.percentile(height - F.col("y_top"), 0.5), 1).alias("top_margin"), F.round(F.percentile("y_low", 0.5), 1).alias("bottom_margin"))
    wide = F.col("columns") == 2
    known = frame.select("doc", "columns", "left", "right", "col_width", "col2_left", "body_pt")
    rows = body.join(known, "doc").join(pages, ["doc", "page"])
    caption = F.col("words").rlike(CAPTION)
    start = F.when(wide & (F.col("x0") >= F.col("col2_left") - 4), F.col("col2_left")).otherwise(F.col("left"))
    unit = F.when(wide, F.col("col_width")).otherwise(F.col("right") - F.col("left"))
    across = caption & wide & (F.col("x0") <= F.col("left") + 0.08 * F.col("col_width")) & (F.col("x1") >= F.col("col2_left") + 0.15 * F.col("col_width"))
    tall = F.when(F.col("y_top") == F.col("y_low"), 1.0).otherwise(F.col("y_top") - F.col("y_low"))
    place = F.when((F.col("y_top") - F.col("y1")) / tall < 0.35, "top").when((F.col("y0") - F.col("y_low")) / tall < 0.35, "bottom").otherwise("mid")
    note = (F.col("size") <= F.col("body_pt") - 0.8) & (F.col("y0") < 0.25 * height) & F.col("words").rlike(FOOTNOTE)
    marked = rows.select("doc", "page", F.bround("y0").alias("y"), snap_size(F.col("size")).alias("caption_pt"), caption.alias("caption"), (F.col("x0") <= start + 0.06 * unit).alias("at_left"), F.when(across, place).alias("place"), note.alias("note"))
    counts = marked.groupBy("doc").agg(
        F.count_if("caption").alias("captions"), F.count_if(F.col("caption") & F.col("at_left")).alias("captions_left"), *[F.count_if(F.col("place") == p).alias(f"across_{p}") for p in ("top", "mid", "bottom")],
        F.count_distinct(F.when(F.col("note"), F.struct("page", "y"))).alias("footnotes"),
    )
    size = _most(marked.where("caption").select("doc", "caption_pt"), ["doc"], "caption_pt", F.count("*"))
    mm = lambda c: F.round(c * 25.4 / 72, 2)
    out = known.join(ends, "doc").join(counts, "doc").join(size, "doc", "left")
    return out.select(
        "doc", F.round("left", 1).alias("left_margin"), F.round(width - F.col("right"), 1).alias("right_margin"), "top_margin", "bottom_margin", mm(F.col("right") - F.col("left")).alias("text_width_mm"),
        mm(height - F.col("top_margin") - F.col("bottom_margin")).alias("text_height_mm"), "columns", "captions", "caption_pt", "captions_left", (F.col("captions") - F.col("captions_left")).alias("captions_center"),
        "across_top", "across_mid", "across_bottom", "footnotes",
    )
