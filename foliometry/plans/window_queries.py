"""Queries of ordered scans, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliometry.functions.scalar import r6
from foliometry.operators import sampling, windows
from foliometry.operators.lineage import cut
from foliometry.operators.quantiles import percentiles
from foliometry.plans.registry import LINES_SQL, LONG_SQL, PAGES_SQL, Tables, query, with_views


@query("avg_rank", with_views(PAGES_SQL, body="SELECT paper, page, rank() OVER w + (count(*) OVER (PARTITION BY paper, quantity) - 1) / 2.0 AS rank FROM pages_ WINDOW w AS (PARTITION BY paper ORDER BY quantity)"))
def avg_rank(t: Tables) -> DataFrame:
    return windows.average_rank(t.pages, ["paper"], "quantity").select("paper", "page", F.col("rank").cast("double").alias("rank"))


RUN = """run_ AS (SELECT {k}, min({o}) AS first, max({o}) AS last, count(*) AS length FROM (SELECT *, n - row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS island FROM
 (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS n FROM {t}) WHERE {c}) GROUP BY {k}, island)"""
LONGEST = "SELECT {k}, first, last, length FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY length DESC, first) AS r FROM run_) WHERE r = 1"


@query("gap_runs", with_views(LINES_SQL, RUN.format(k="doc", o="line", t="lines_", c="length(text) < 20"), body=LONGEST.format(k="doc").replace("length FROM", "length, (first + last) / 2.0 AS centre FROM")))
def gap_runs(t: Tables) -> DataFrame:
    """Longest run of short lines of each document, with its centre."""
    return windows.longest_run(t.lines, ["doc"], "line", F.length("text") < 20).withColumn("centre", (F.col("first") + F.col("last")) / 2)


INK = """ink_ AS (SELECT doc, line AS r, length(text) AS ink, least(length(text), 80) AS span FROM lines_),
p90_ AS (SELECT doc, list_sort(list(span))[CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1] AS p90 FROM ink_ GROUP BY doc), flag_ AS (SELECT * FROM ink_ JOIN p90_ USING (doc))"""


@query("solid_band_runs", with_views(LINES_SQL, INK, RUN.format(k="doc", o="r", t="flag_", c="span >= 0.85 * p90 AND ink >= 0.55 * span"), body=LONGEST.format(k="doc")))
def solid_band_runs(t: Tables) -> DataFrame:
    """Longest run of rows whose span is near the document's 90th percentile and whose fill is high."""
    from foliometry.operators.aggregates import at_ranks

    ink = t.lines.select("doc", F.col("line").alias("r"), F.length("text").alias("ink"), F.least(F.length("text"), F.lit(80)).alias("span"))
    p90 = at_ranks(ink, ["doc"], {"p90": F.floor(0.9 * (F.col("n") - 1))}, "span").select("doc", "p90")
    rows = ink.join(p90, "doc")
    return windows.longest_run(rows, ["doc"], "r", (F.col("span") >= 0.85 * F.col("p90")) & (F.col("ink") >= 0.55 * F.col("span")))


@query("page_ink_metrics", with_views(LINES_SQL, body="""SELECT doc, h, round(sum(ink) / (80.0 * h), 9) AS ink_ratio, coalesce(min(r) FILTER (WHERE ink > 0), h) AS top_blank, h - 1 - coalesce(max(r) FILTER (WHERE ink > 0), -1) AS bottom_blank,
round(CASE WHEN sum(ink) FILTER (WHERE r >= h / 2.0) > 0 THEN coalesce(sum(ink) FILTER (WHERE r < h / 2.0), 0) / sum(ink) FILTER (WHERE r >= h / 2.0) END, 6) AS top_bottom_ratio
FROM (SELECT doc, line AS r, length(text) AS ink, count(*) OVER (PARTITION BY doc) AS h FROM lines_) GROUP BY doc, h"""))
def page_ink_metrics(t: Tables) -> DataFrame:
    h = F.count("*").over(W.partitionBy("doc"))
    rows = t.lines.select("doc", F.col("line").alias("r"), F.length("text").alias("ink"), h.alias("h"))
    some, top = F.col("ink") > 0, F.col("r") < F.col("h") / 2
    upper, lower = F.coalesce(F.sum(F.when(top, F.col("ink"))), F.lit(0)), F.sum(F.when(~top, F.col("ink")))
    return rows.groupBy("doc", "h").agg(
        F.round(F.sum("ink") / (80.0 * F.first("h")), 9).alias("ink_ratio"), F.coalesce(F.min(F.when(some, F.col("r"))), F.first("h")).alias("top_blank"), (F.first("h") - 1 - F.coalesce(F.max(F.when(some, F.col("r"))), F.lit(-1))).alias("bottom_blank"),
        r6(F.when(lower > 0, upper / lower)).alias("top_bottom_ratio"),
    )


@query("pixel_role", with_views(LINES_SQL, body="""SELECT doc, line, CASE WHEN ink < 5 THEN 'near-empty' WHEN ink < 0.5 * med THEN 'sparse' WHEN ink > 1.5 * med THEN 'dense' ELSE 'body' END AS role, line = 0 AS is_first, line = n AS is_last
FROM (SELECT doc, line, length(text) AS ink FROM lines_) JOIN (SELECT doc, quantile_cont(length(text), 0.5) AS med, max(line) AS n FROM lines_ GROUP BY doc) USING (doc)"""))
def pixel_role(t: Tables) -> DataFrame:
    """Class of each line by its ink relative to the document's median."""
    ink = t.lines.select("doc", "line", F.length("text").alias("ink"))
    doc = ink.groupBy("doc").agg(F.percentile("ink", 0.5).alias("med"), F.max("line").alias("n"))
    role = F.when(F.col("ink") < 5, "near-empty").when(F.col("ink") < 0.5 * F.col("med"), "sparse").when(F.col("ink") > 1.5 * F.col("med"), "dense").otherwise("body")
    return ink.join(doc, "doc").select("doc", "line", role.alias("role"), (F.col("line") == 0).alias("is_first"), (F.col("line") == F.col("n")).alias("is_last"))


@query("section_state", """SELECT event_id, CASE WHEN max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w = 1 THEN 'appendix' WHEN max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w = 1 THEN 'references' ELSE 'body' END AS state
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def section_state(t: Tables) -> DataFrame:
    """State of each step: references from their marker on, appendix (absorbing) from its marker on."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    seen = lambda kind: F.max(F.when(F.col("event_type") == kind, 1).otherwise(0)).over(w) == 1
    return t["events"].select("event_id", F.when(seen("purchase"), "appendix").when(seen("signup"), "references").otherwise("body").alias("state"))


@query("page_role", with_views(LINES_SQL, body="""SELECT doc, line, CASE WHEN line = 0 AND length(trim(text)) > 0 THEN 'title' WHEN length(trim(text)) = 0 THEN 'unknown' WHEN refs = 1 THEN 'references' WHEN contains(text, '|') THEN 'table' WHEN regexp_matches(text, '[0-9]{9,}') THEN 'data'
 WHEN length(text) < 30 THEN 'short' ELSE 'body' END AS role FROM (SELECT *, max(CASE WHEN contains(text, 'License') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line) AS refs FROM lines_)"""))
def page_role(t: Tables) -> DataFrame:
    """Prioritised classes with a running section state."""
    w = W.partitionBy("doc").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    x, size = F.col("text"), F.length(F.btrim("text"))
    refs = F.max(F.when(x.contains("License"), 1).otherwise(0)).over(w)
    role = F.when((F.col("line") == 0) & (size > 0), "title").when(size == 0, "unknown").when(refs == 1, "references").when(x.contains("|"), "table").when(x.rlike("[0-9]{9,}"), "data").when(F.length("text") < 30, "short").otherwise("body")
    return t.lines.select("doc", "line", role.alias("role"))


@query("content_page_bounds", with_views(LINES_SQL, body="""SELECT doc, CASE WHEN min(line) FILTER (WHERE line >= 1 AND regexp_matches(text, '[0-9]')) IS NULL THEN max(line) + 1 ELSE greatest(min(line) FILTER (WHERE line >= 1 AND regexp_matches(text, '[0-9]')) - 1, 1) END AS lower, coalesce(min(line) FILTER (WHERE line >= 1 AND regexp_matches(text, '[0-9]')), max(line) + 1) AS upper FROM lines_ GROUP BY doc"""))
def content_page_bounds(t: Tables) -> DataFrame:
    hit = F.min(F.when((F.col("line") >= 1) & F.col("text").rlike("[0-9]"), F.col("line")))
    total = F.max("line") + 1
    return t.lines.groupBy("doc").agg(F.when(hit.isNull(), total).otherwise(F.greatest(hit - 1, F.lit(1))).alias("lower"), F.coalesce(hit, total).alias("upper"))


STEPS = "steps_ AS (SELECT user_id AS doc, event_id AS seq, value AS p, CAST(event_id % 17 AS DOUBLE) AS i, event_type IN ('click', 'view') AS accepted FROM events)"


def steps(t: Tables) -> DataFrame:
    return t["events"].select(F.col("user_id").alias("doc"), F.col("event_id").alias("seq"), F.col("value").alias("p"), (F.col("event_id") % 17).cast("double").alias("i"), F.col("event_type").isin("click", "view").alias("accepted"))


@query("step_deltas", with_views(STEPS, body="""SELECT doc, seq, p, i, accepted, round(p - bp, 6) AS d_p, round(i - bi, 6) AS d_i FROM (
 SELECT *, last_value(CASE WHEN seed THEN p END IGNORE NULLS) OVER w AS bp, last_value(CASE WHEN seed THEN i END IGNORE NULLS) OVER w AS bi FROM (SELECT *, accepted OR row_number() OVER (PARTITION BY doc ORDER BY seq) = 1 AS seed FROM steps_)
 WINDOW w AS (PARTITION BY doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE bp IS NOT NULL"""))
def step_deltas(t: Tables) -> DataFrame:
    return windows.step_deltas(steps(t), "doc", "seq", "accepted", ["p", "i"])


@query("exchange_rate", with_views(STEPS, body="""SELECT doc, count(*) AS n, round(quantile_cont(rho, 0.5), 6) AS median, round(quantile_cont(rho, 0.25), 6) AS p25, round(quantile_cont(rho, 0.75), 6) AS p75, round(greatest(0.1, least(10.0, quantile_cont(rho, 0.5))), 6) AS decided FROM (
 SELECT doc, (i - bi) / -(p - bp) AS rho FROM (SELECT *, last_value(CASE WHEN seed THEN p END IGNORE NULLS) OVER w AS bp, last_value(CASE WHEN seed THEN i END IGNORE NULLS) OVER w AS bi FROM (SELECT *, accepted OR row_number() OVER (PARTITION BY doc ORDER BY seq) = 1 AS seed FROM steps_)
 WINDOW w AS (PARTITION BY doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE bp IS NOT NULL AND p - bp < -1e-9) GROUP BY doc"""))
def exchange_rate(t: Tables) -> DataFrame:
    """What is paid in I for each unit of P repaired: median and quartiles, clipped."""
    d = windows.step_deltas(steps(t), "doc", "seq", "accepted", ["p", "i"]).where("d_p < -1e-9").withColumn("rho", F.col("d_i") / -F.col("d_p"))
    q = lambda x: F.percentile("rho", x)
    return d.groupBy("doc").agg(F.count("*").alias("n"), r6(q(0.5)).alias("median"), r6(q(0.25)).alias("p25"), r6(q(0.75)).alias("p75"), r6(F.greatest(F.lit(0.1), F.least(F.lit(10.0), q(0.5)))).alias("decided"))


@query("monotone_check", """SELECT user_id, count(*) AS n, count(*) FILTER (WHERE d < -1e-4 * greatest(abs(prev), 1e-9)) AS falls, count(*) FILTER (WHERE d > 0) AS strict, round(coalesce(min(d), 0), 6) AS worst,
count(*) FILTER (WHERE d < -1e-4 * greatest(abs(prev), 1e-9)) = 0 AND max_by(cum, event_id) - min_by(cum, event_id) > 1e-9 AS ok FROM (SELECT *, cum - lag(cum) OVER (PARTITION BY user_id ORDER BY event_id) AS d, lag(cum) OVER (PARTITION BY user_id ORDER BY event_id) AS prev
 FROM (SELECT user_id, event_id, sum(CASE WHEN user_id % 3 = 0 AND event_type = 'error' THEN -value ELSE value END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cum FROM events)) GROUP BY user_id""")
def monotone_check(t: Tables) -> DataFrame:
    signed = F.when((F.col("user_id") % 3 == 0) & (F.col("event_type") == "error"), -F.col("value")).otherwise(F.col("value"))
    cum = F.sum(signed).over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0))
    return windows.monotone(t["events"].select("user_id", "event_id", cum.alias("cum")), ["user_id"], "event_id", "cum")


CURVE = "curve_ AS (SELECT p_brand AS k, CAST(p_size AS DOUBLE) AS cost, round(avg(CASE WHEN p_retailprice > 950 + 3 * p_size THEN 1.0 ELSE 0.0 END), 6) AS share FROM part GROUP BY 1, 2)"


@query("crossing_point", with_views(CURVE, body="""SELECT k, round(coalesce(min_by(CASE WHEN b0 IS NULL OR b0 = share THEN cost ELSE c0 + (b0 - 0.5) / (b0 - share) * (cost - c0) END, cost) FILTER (WHERE share <= 0.5), max(cost)), 6) AS point, coalesce(bool_or(share <= 0.5), false) AS crossed
FROM (SELECT *, lag(cost) OVER (PARTITION BY k ORDER BY cost) AS c0, lag(share) OVER (PARTITION BY k ORDER BY cost) AS b0 FROM curve_) GROUP BY k"""))
def crossing_point(t: Tables) -> DataFrame:
    curve = t["part"].groupBy(F.col("p_brand").alias("k"), F.col("p_size").cast("double").alias("cost")).agg(r6(F.avg(F.when(F.col("p_retailprice") > 950 + 3 * F.col("p_size"), 1.0).otherwise(0.0))).alias("share"))
    return windows.crossing(curve, "k", "cost", "share")


@query("line_spacing", """SELECT user_id, round(quantile_cont(gap, 0.5), 6) AS leading, count(*) AS n FROM (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NOT NULL GROUP BY user_id""")
def line_spacing(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t["events"].select("user_id", (s - F.lag(s).over(w)).alias("gap")).where("gap is not null").groupBy("user_id").agg(r6(F.percentile("gap", 0.5)).alias("leading"), F.count("*").alias("n"))


@query("sweep_coverage", """WITH e AS (SELECT l_suppkey AS k, l_quantity AS x, 1 AS d FROM lineitem UNION ALL SELECT l_suppkey, l_quantity + 5 + l_linenumber, -1 FROM lineitem), n AS (SELECT k, x, sum(d) AS d FROM e GROUP BY k, x),
c AS (SELECT k, x AS lo, lead(x) OVER w AS hi, sum(d) OVER (PARTITION BY k ORDER BY x ROWS UNBOUNDED PRECEDING) AS cover FROM n WINDOW w AS (PARTITION BY k ORDER BY x))
SELECT k, lo AS "from", hi AS "to", CAST(cover AS BIGINT) AS cover FROM c WHERE hi IS NOT NULL""")
def sweep_coverage(t: Tables) -> DataFrame:
    rows = t["lineitem"].select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 5 + F.col("l_linenumber")).alias("x1"))
    return windows.over_coverage(rows, ["k"], "x0", "x1")


@query("relative_to_group", with_views(PAGES_SQL, body="SELECT paper, venue, round(score / med, 6) AS relative FROM (SELECT paper, venue, avg(price) AS score FROM pages_ GROUP BY 1, 2) JOIN (SELECT venue, quantile_cont(score, 0.5) AS med FROM (SELECT paper, venue, avg(price) AS score FROM pages_ GROUP BY 1, 2) GROUP BY venue) USING (venue)"))
def relative_to_group(t: Tables) -> DataFrame:
    score = cut(t.pages.groupBy("paper", "venue").agg(F.avg("price").alias("score")))
    med = percentiles(score, ["venue"], (0.5,), "score").select("venue", F.col("p")[0].alias("med"))
    return score.join(med, "venue").select("paper", "venue", r6(F.col("score") / F.col("med")).alias("relative"))


@query("rank_of_target", with_views(PAGES_SQL, body="""SELECT paper, page, CAST(r AS BIGINT) AS r, r <= 1 AS top1, r <= 3 AS top3 FROM (SELECT paper, page, discount, row_number() OVER (PARTITION BY paper ORDER BY price DESC, page) AS r FROM pages_) WHERE page % 50 = 7"""))
def rank_of_target(t: Tables) -> DataFrame:
    """Rank of marked pages by a score within their paper."""
    r = F.row_number().over(W.partitionBy("paper").orderBy(F.desc("price"), "page")).cast("long")
    return t.pages.select("paper", "page", r.alias("r")).where("page % 50 = 7").withColumns({"top1": F.col("r") <= 1, "top3": F.col("r") <= 3})


@query("sequence_ids", """WITH have AS (SELECT p_brand, max(CAST(regexp_extract(p_brand || '-' || lpad(CAST(p_partkey AS VARCHAR), 5, '0'), '([0-9]+)$', 1) AS BIGINT)) AS top FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT p_partkey, p.p_brand, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY p.p_brand ORDER BY p_partkey) AS BIGINT) AS idx FROM part p LEFT JOIN have h ON h.p_brand = p.p_brand WHERE p_partkey % 2 = 1""")
def sequence_ids(t: Tables) -> DataFrame:
    """New rows numbered on from the largest number in the existing ids of their group."""
    part = t["part"]
    ids = F.concat("p_brand", F.lit("-"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"))
    have = part.where("p_partkey % 2 = 0").groupBy("p_brand").agg(F.max(F.regexp_extract(ids, "([0-9]+)$", 1).cast("long")).alias("top"))
    new = part.where("p_partkey % 2 = 1").select("p_partkey", "p_brand")
    return new.join(have, "p_brand", "left").select("p_partkey", "p_brand", (F.coalesce("top", F.lit(0)) + F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))).cast("long").alias("idx"))


@query("topk_pairs", """SELECT a, b, rho FROM (SELECT x.venue AS a, y.venue AS b, round(x.m - y.m, 6) AS rho FROM (SELECT CAST(s_nationkey AS BIGINT) AS venue, avg(s_acctbal) AS m FROM supplier GROUP BY 1) x, (SELECT CAST(s_nationkey AS BIGINT) AS venue, avg(s_acctbal) AS m FROM supplier GROUP BY 1) y WHERE x.venue < y.venue) ORDER BY abs(rho) DESC, a, b LIMIT 15""")
def topk_pairs(t: Tables) -> DataFrame:
    """The strongest 15 pairs of a pair table (here: of venue means, one row a venue)."""
    m = t["supplier"].groupBy(F.col("s_nationkey").cast("long").alias("venue")).agg(F.avg("s_acctbal").alias("m"))
    pairs = m.alias("x").join(m.alias("y"), F.col("x.venue") < F.col("y.venue")).select(F.col("x.venue").alias("a"), F.col("y.venue").alias("b"), r6(F.col("x.m") - F.col("y.m")).alias("rho"))
    return pairs.orderBy(F.desc(F.abs("rho")), "a", "b").limit(15)


@query("topn_anomalous", with_views(LONG_SQL, body="""SELECT paper, page, dim, k FROM (SELECT paper, page, max_by(dim, (value, dim)) AS dim, row_number() OVER (PARTITION BY paper ORDER BY sum(value) DESC, page) AS k FROM long_ GROUP BY paper, page) WHERE k <= 3"""))
def topn_anomalous(t: Tables) -> DataFrame:
    """Three pages of the largest sum in each paper, with the dim that adds most."""
    pages = t.long.groupBy("paper", "page").agg(F.sum("value").alias("s"), F.max_by("dim", F.struct("value", "dim")).alias("dim"))
    return windows.top_k(pages, ["paper"], [F.desc("s"), F.col("page")], 3).select("paper", "page", "dim", "k")


@query("systematic_sample", """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents) WHERE rn IN (SELECT CAST(floor(i * n / 60) AS BIGINT) FROM (SELECT unnest(range(60)) AS i))""")
def systematic_sample(t: Tables) -> DataFrame:
    return sampling.systematic(t["documents"].select("doc_id"), "doc_id", 60)


@query("tercile_sample", """WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents), g AS (SELECT *, CASE WHEN rn < n // 3 THEN 0 WHEN rn < 2 * (n // 3) THEN 1 ELSE 2 END AS third FROM r)
SELECT doc_id, CAST(third AS BIGINT) AS third FROM g WHERE (rn - third * (n // 3)) % greatest(n // 3 // 5, 1) = 0""")
def tercile_sample(t: Tables) -> DataFrame:
    return sampling.terciles(t["documents"].select("doc_id", "n_chars"), ["n_chars", "doc_id"], 5).select("doc_id", "third")


@query("one_page_per_paper", with_views(PAGES_SQL, body="""SELECT paper, page FROM (SELECT paper, page, row_number() OVER (PARTITION BY paper ORDER BY (page * 7919 + paper * 104729 + 13) % 1000003, page) AS k FROM pages_ JOIN (SELECT paper, max(page) AS last FROM pages_ GROUP BY paper) USING (paper) WHERE page > 1 AND page < last AND discount < 0.06) WHERE k = 1"""))
def one_page_per_paper(t: Tables) -> DataFrame:
    last = t.pages.groupBy("paper").agg(F.max("page").alias("last"))
    rows = t.pages.join(last, "paper").where("page > 1 and page < last and discount < 0.06")
    return sampling.one_per_group(rows, ["paper"], ["page", "paper"]).select("paper", "page")


@query("dedupe_first", "SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_first(t: Tables) -> DataFrame:
    docs = t["documents"].select("doc_id", "text")
    first = docs.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return docs.join(first, "doc_id", "left_semi")


@query("quota_pick", """WITH q AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 7919 + 13) % 1000003, doc_id) AS k FROM documents)
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN k <= 20 THEN 0 ELSE 1 END, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END, k) AS r FROM q) WHERE r <= 100""")
def quota_pick(t: Tables) -> DataFrame:
    """A quota of each kind, then the others in a fixed order of kinds, 100 rows in all."""
    mixed = F.pmod(F.col("doc_id") * 7919 + 13, F.lit(1000003))
    k = F.row_number().over(W.partitionBy("lang").orderBy(mixed, "doc_id"))
    order = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    rows = t["documents"].select("doc_id", "lang", k.alias("k")).where("k <= 120")  # no kind can give more than the whole pick
    return rows.orderBy(F.when(F.col("k") <= 20, 0).otherwise(1), order, "k").limit(100).select("doc_id", "lang")


@query("train_test_complement", "SELECT DISTINCT l_suppkey AS paper FROM lineitem EXCEPT SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 = 0")
def train_test_complement(t: Tables) -> DataFrame:
    test = t["supplier"].where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("paper"))
    return t["lineitem"].select(F.col("l_suppkey").alias("paper")).distinct().join(test, "paper", "left_anti")


@query("key_union", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def key_union(t: Tables) -> DataFrame:
    return t["orders"].select(F.col("o_custkey").alias("k")).union(t["customer"].select("c_custkey")).distinct()


@query("page_intersection", "SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O'")
def page_intersection(t: Tables) -> DataFrame:
    x = t["lineitem"]
    return x.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("k")).intersect(x.where("l_linestatus = 'O'").select("l_orderkey"))


@query("unknown_keys", "SELECT DISTINCT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def unknown_keys(t: Tables) -> DataFrame:
    allowed = t["customer"].where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return t["orders"].select(F.col("o_custkey").alias("k")).distinct().join(allowed, "k", "left_anti")


@query("level_union", with_views(PAGES_SQL, body="SELECT 'role' AS level, role AS key, count(*) AS n FROM pages_ GROUP BY role UNION ALL SELECT 'layout', layout, count(*) FROM pages_ GROUP BY layout"))
def level_union(t: Tables) -> DataFrame:
    rows = [t.pages.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).select(F.lit(c).alias("level"), "key", "n") for c in ("role", "layout")]
    return rows[0].unionByName(rows[1])
