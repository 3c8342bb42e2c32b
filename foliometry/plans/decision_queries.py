"""Queries of decisions: gates, acceptance, scores of versions, requirements, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliometry.functions import scalar
from foliometry.functions.scalar import r6
from foliometry.operators.lineage import cut
from foliometry.operators.quantiles import joined, percentiles
from foliometry.plans.registry import LINES_SQL, LOGS_SQL, PAGES_SQL, Tables, query, with_views
from foliometry.plans.text_queries import ISSUE, issues
from foliometry.plans.window_queries import STEPS, steps

VERSIONS = "v_ AS (SELECT o_custkey AS doc, o_orderkey AS ver, o_orderkey % 4 AS n_gate, round(o_totalprice / 1000, 3) AS m1, CAST(o_orderkey % 9 AS DOUBLE) AS m2 FROM orders)"


def versions(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t["orders"].select(F.col("o_custkey").alias("doc"), k.alias("ver"), (k % 4).alias("n_gate"), F.round(F.col("o_totalprice") / 1000, 3).alias("m1"), (k % 9).cast("double").alias("m2"))


@query("version_steps", with_views(VERSIONS, body="SELECT doc, ver, CASE WHEN prev IS NULL THEN 'first' WHEN n_gate < pg THEN 'fewer violations' WHEN n_gate > pg THEN 'rejected' WHEN m1 < pm1 THEN 'lower m1' WHEN m1 > pm1 THEN 'rejected' WHEN m2 < pm2 THEN 'lower m2' ELSE 'rejected' END AS reason FROM (SELECT *, lag(ver) OVER w AS prev, lag(n_gate) OVER w AS pg, lag(m1) OVER w AS pm1, lag(m2) OVER w AS pm2 FROM v_ WINDOW w AS (PARTITION BY doc ORDER BY ver))"))
def version_steps(t: Tables) -> DataFrame:
    """Each version against the one before: violations first, then m1, then m2."""
    w = W.partitionBy("doc").orderBy("ver")
    p = lambda c: F.lag(c).over(w)
    why = F.when(p("ver").isNull(), "first").when(F.col("n_gate") < p("n_gate"), "fewer violations").when(F.col("n_gate") > p("n_gate"), "rejected").when(F.col("m1") < p("m1"), "lower m1").when(F.col("m1") > p("m1"), "rejected").when(F.col("m2") < p("m2"), "lower m2").otherwise("rejected")
    return versions(t).select("doc", "ver", why.alias("reason"))


@query("model_score", with_views(VERSIONS, body="SELECT doc, arg_min(ver, (n_gate, m1, m2, ver)) AS best, round(min(2.0 * m1 + m2 + 0.5 * n_gate), 6) AS score FROM v_ GROUP BY doc"))
def model_score(t: Tables) -> DataFrame:
    """Best version by (violations, m1, m2), and the least total score."""
    return versions(t).groupBy("doc").agg(F.min(F.struct("n_gate", "m1", "m2", "ver")).alias("b"), r6(F.min(2.0 * F.col("m1") + F.col("m2") + 0.5 * F.col("n_gate"))).alias("score")).select("doc", F.col("b.ver").alias("best"), "score")


@query("step_status", with_views(STEPS, body="SELECT doc, CASE WHEN min(i) > 0 THEN 'gate' WHEN count(*) FILTER (WHERE accepted) = 0 THEN 'no_change' WHEN max(p) > 90 THEN 'defects' ELSE 'ok' END AS status, count(*) AS attempts FROM steps_ GROUP BY doc"))
def step_status(t: Tables) -> DataFrame:
    status = F.when(F.min("i") > 0, "gate").when(F.count_if("accepted") == 0, "no_change").when(F.max("p") > 90, "defects").otherwise("ok")
    return steps(t).groupBy("doc").agg(status.alias("status"), F.count("*").alias("attempts"))


@query("conflict_gate", with_views(VERSIONS, body="SELECT a.doc, a.ver, a.n_gate <= b.n_gate AND a.m2 <= b.m2 AND a.m1 < b.m1 AS allowed FROM v_ a JOIN (SELECT doc, arg_min(n_gate, ver) AS n_gate, arg_min(m1, ver) AS m1, arg_min(m2, ver) AS m2, min(ver) AS ver FROM v_ GROUP BY doc) b ON a.doc = b.doc WHERE a.ver <> b.ver"))
def conflict_gate(t: Tables) -> DataFrame:
    """A version is allowed if neither hard count is worse than the base's and its score is better."""
    v = versions(t)
    base = v.groupBy("doc").agg(F.min(F.struct("ver", "n_gate", "m1", "m2")).alias("b"))
    j = v.join(base, "doc").where("ver <> b.ver")
    return j.select("doc", "ver", ((F.col("n_gate") <= F.col("b.n_gate")) & (F.col("m2") <= F.col("b.m2")) & (F.col("m1") < F.col("b.m1"))).alias("allowed"))


GATE_RULES = {"size": "length(text) > 8000", "bars": "contains(text, '|')", "no_end": "NOT regexp_matches(text, '[.!?]$')", "long_number": "regexp_matches(text, '[0-9]{16,}')"}


@query("text_rules", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS rule, {str(k in ('bars', 'no_end')).lower()} AS repairable FROM documents WHERE {c}" for k, c in GATE_RULES.items()))
def gate_rules(t: Tables) -> DataFrame:
    """A row for each violated rule of each document."""
    x = F.col("text")
    tests = {"size": F.length(x) > 8000, "bars": x.contains("|"), "no_end": ~x.rlike("[.!?]$"), "long_number": x.rlike("[0-9]{16,}")}
    rules = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("rule"), F.lit(k in ("bars", "no_end")).alias("repairable"))) for k, c in tests.items()]))
    return t["documents"].select("doc_id", F.explode(rules).alias("r")).select("doc_id", "r.rule", "r.repairable")


@query("version_audit", with_views("r_ AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS rule FROM documents WHERE {c}" for k, c in GATE_RULES.items()) + ")", body="SELECT d.doc_id, count(r.rule) AS n_rules, CASE WHEN count(r.rule) = 0 THEN 'ok' WHEN count(r.rule) = 1 THEN 'warn' ELSE 'fail' END AS status FROM documents d LEFT JOIN r_ r USING (doc_id) GROUP BY d.doc_id"))
def version_audit(t: Tables) -> DataFrame:
    n = gate_rules(t).groupBy("doc_id").agg(F.count("*").alias("n"))
    j = t["documents"].select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_rules"))
    return j.withColumn("status", F.when(F.col("n_rules") == 0, "ok").when(F.col("n_rules") == 1, "warn").otherwise("fail"))


@query("page_verdict", with_views(LINES_SQL, body="SELECT doc, total, content, CASE WHEN total <= 8 AND content <= 8 THEN 'within' WHEN content <= 8 THEN 'over_soft' WHEN content <= 10 THEN 'borderline' ELSE 'over_strict' END AS verdict FROM (SELECT doc, count(*) AS total, count(*) FILTER (WHERE length(text) > 40) AS content FROM lines_ GROUP BY doc)"))
def page_verdict(t: Tables) -> DataFrame:
    g = t.lines.groupBy("doc").agg(F.count("*").alias("total"), F.count_if(F.length("text") > 40).alias("content"))
    v = F.when((F.col("total") <= 8) & (F.col("content") <= 8), "within").when(F.col("content") <= 8, "over_soft").when(F.col("content") <= 10, "borderline").otherwise("over_strict")
    return g.withColumn("verdict", v)


@query("ab_runs", "SELECT o_custkey AS doc, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 6) AS f, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 6) AS o, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') - avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 6) AS diff FROM orders GROUP BY o_custkey")
def ab_runs(t: Tables) -> DataFrame:
    """Documents by parameter, side by side, with the difference."""
    p = t["orders"].groupBy(F.col("o_custkey").alias("doc")).pivot("o_orderstatus", ["F", "O"]).agg(F.avg("o_totalprice"))
    return p.select("doc", r6("F").alias("f"), r6("O").alias("o"), r6(F.col("F") - F.col("O")).alias("diff"))


@query("staged_commit")
def staged_commit(t: Tables) -> DataFrame:
    """Trace fold: a step with less P commits, neutral steps are staged, a chain of three without gain is rolled back."""
    zero = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("staged"), F.lit(0).alias("commits"), F.lit(0).alias("rollbacks"))

    def fold(s: F.Column, x: F.Column) -> F.Column:
        gain = s["best"].isNull() | (x["p"] < s["best"] - 1e-9)
        full = ~gain & (s["staged"] >= 2)
        return F.struct(F.when(gain, x["p"]).otherwise(s["best"]).alias("best"), F.when(gain | full, F.lit(0)).otherwise(s["staged"] + 1).alias("staged"), (s["commits"] + gain.cast("int")).alias("commits"), (s["rollbacks"] + full.cast("int")).alias("rollbacks"))

    g = steps(t).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("seq", "p"))).alias("steps"))
    return g.select("doc", F.aggregate("steps", zero, fold).alias("s")).select("doc", r6(F.col("s.best")).alias("best"), "s.commits", "s.rollbacks", "s.staged")


LAYERS = "layer_ AS (SELECT p_partkey % 200 AS doc, p_type AS key, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS value, p_partkey AS prio FROM part)"


@query("requirement_merge", with_views(LAYERS, body="SELECT doc, key, arg_max(value, prio) AS value FROM layer_ WHERE value IS NOT NULL GROUP BY doc, key"))
def requirement_merge(t: Tables) -> DataFrame:
    """The value of the highest layer that gives one."""
    rows = t["part"].select((F.col("p_partkey") % 200).alias("doc"), F.col("p_type").alias("key"), F.when(F.col("p_size") % 4 != 0, F.col("p_size").cast("string")).alias("value"), F.col("p_partkey").alias("prio"))
    return rows.where("value is not null").groupBy("doc", "key").agg(F.max_by("value", "prio").alias("value"))


@query("coalesce_provenance", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN p_size WHEN p_partkey % 3 = 0 THEN CAST(floor(p_retailprice / 100) AS INTEGER) ELSE 25 END AS value, CASE WHEN p_size <= 10 THEN 'official' WHEN p_partkey % 3 = 0 THEN 'derived' ELSE 'sample' END AS basis FROM part")
def coalesce_provenance(t: Tables) -> DataFrame:
    """The official value, else the derived one, else the sample's, with its basis."""
    s = lambda c, b: F.struct(c.cast("int").alias("value"), F.lit(b).alias("basis"))
    best = F.coalesce(F.when(F.col("p_size") <= 10, s(F.col("p_size"), "official")), F.when(F.col("p_partkey") % 3 == 0, s(F.floor(F.col("p_retailprice") / 100), "derived")), s(F.lit(25), "sample"))
    return t["part"].select("p_partkey", best.alias("b")).select("p_partkey", "b.value", "b.basis")


PROJ = "proj_(field, kind, basis) AS (VALUES ('a', 'ECONOMY', 'small'), ('b', 'STANDARD', 'red'), ('c', 'ECONOMY', 'blue'), ('d', 'PROMO', 'green'), ('e', 'NONE', 'x'))"
PROJ_ROWS = [("a", "ECONOMY", "small"), ("b", "STANDARD", "red"), ("c", "ECONOMY", "blue"), ("d", "PROMO", "green"), ("e", "NONE", "x")]


@query("brand_projection", with_views(PROJ, body="SELECT p_brand, field, min(p_size) AS value FROM part JOIN proj_ ON p_type = kind AND starts_with(p_name, basis) GROUP BY p_brand, field"))
def brand_projection(t: Tables) -> DataFrame:
    """Constraint rows mapped to fields, of permitted bases only."""
    proj = t.spark.createDataFrame(PROJ_ROWS, "field string, kind string, basis string")
    j = t["part"].join(F.broadcast(proj), F.col("p_type") == F.col("kind"))  # a fixed table of six rows
    return j.where(F.col("p_name").startswith(F.col("basis"))).groupBy("p_brand", "field").agg(F.min("p_size").alias("value"))


@query("spec_deferred", with_views(PROJ, "b_ AS (SELECT DISTINCT p_brand FROM part)", "got_ AS (SELECT DISTINCT p_brand, field FROM part JOIN proj_ ON p_type = kind AND starts_with(p_name, basis))", body="SELECT b_.p_brand, proj_.field, CASE WHEN kind = 'NONE' THEN 'no source' ELSE 'basis not permitted' END AS reason FROM b_, proj_ WHERE (b_.p_brand, proj_.field) NOT IN (SELECT (p_brand, field) FROM got_)".replace("(b_.p_brand, proj_.field) NOT IN (SELECT (p_brand, field) FROM got_)", "NOT EXISTS (SELECT 1 FROM got_ g WHERE g.p_brand = b_.p_brand AND g.field = proj_.field)")))
def spec_deferred(t: Tables) -> DataFrame:
    """Fields that could not be projected, with a reason."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit("no source" if k == "NONE" else "basis not permitted").alias("reason")) for f, k, _ in PROJ_ROWS]))
    all_ = t["part"].select("p_brand").distinct().select("p_brand", fields.alias("f")).select("p_brand", "f.field", "f.reason")
    return all_.join(brand_projection(t).select("p_brand", "field"), ["p_brand", "field"], "left_anti")


@query("deferred_summary", with_views(PROJ, "b_ AS (SELECT DISTINCT p_brand FROM part)", "got_ AS (SELECT DISTINCT p_brand, field FROM part JOIN proj_ ON p_type = kind AND starts_with(p_name, basis))", body="SELECT reason, count(*) AS n, count(DISTINCT field) AS n_fields, count(DISTINCT p_brand) AS n_venues FROM (SELECT b_.p_brand, proj_.field, CASE WHEN kind = 'NONE' THEN 'no source' ELSE 'basis not permitted' END AS reason FROM b_, proj_ WHERE NOT EXISTS (SELECT 1 FROM got_ g WHERE g.p_brand = b_.p_brand AND g.field = proj_.field)) GROUP BY reason"))
def deferred_summary(t: Tables) -> DataFrame:
    return spec_deferred(t).groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("field").alias("n_fields"), F.count_distinct("p_brand").alias("n_venues"))


@query("field_reliability", "SELECT p_brand, string_agg(p_type, ',' ORDER BY p_type) FILTER (WHERE n >= 14) AS reliable, string_agg(p_type, ',' ORDER BY p_type) FILTER (WHERE n < 14) AS unreliable FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY p_brand")
def field_reliability(t: Tables) -> DataFrame:
    g = t["part"].groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).groupBy("p_brand")
    named = lambda c: F.nullif(F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("p_type")))), ","), F.lit(""))
    return g.agg(named(F.col("n") >= 14).alias("reliable"), named(F.col("n") < 14).alias("unreliable"))


@query("part_anomalies", "SELECT p_partkey, rule FROM (SELECT p_partkey, unnest([CASE WHEN p_size < 4 THEN 'few_pages' END, CASE WHEN p_size > 46 THEN 'many_pages' END, CASE WHEN p_retailprice % 100 < 1 THEN 'zero_refs' END]) AS rule FROM part) WHERE rule IS NOT NULL")
def part_anomalies(t: Tables) -> DataFrame:
    rules = F.array_compact(F.array(F.when(F.col("p_size") < 4, "few_pages"), F.when(F.col("p_size") > 46, "many_pages"), F.when(F.col("p_retailprice") % 100 < 1, "zero_refs")))
    return t["part"].select("p_partkey", F.explode(rules).alias("rule"))


@query("pivot_matrix", "SELECT p_brand, " + ", ".join(f"min(p_size) FILTER (WHERE p_type = '{k}') AS {k.lower()}" for k in ("ECONOMY", "STANDARD", "PROMO")) + " FROM part GROUP BY p_brand")
def pivot_matrix(t: Tables) -> DataFrame:
    p = t["part"].groupBy("p_brand").pivot("p_type", ["ECONOMY", "STANDARD", "PROMO"]).agg(F.min("p_size"))
    return p.select("p_brand", *[F.col(k).alias(k.lower()) for k in ("ECONOMY", "STANDARD", "PROMO")])


@query("change_history", "SELECT o_custkey AS k, count(*) AS n, year(max(o_orderdate)) AS last_year, year(max(o_orderdate)) <= max(max(year(o_orderdate))) OVER () - 2 AND count(*) = 1 AS stale FROM orders GROUP BY o_custkey")
def change_history(t: Tables) -> DataFrame:
    g = t["orders"].groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.year(F.max("o_orderdate")).cast("long").alias("last_year"))
    newest = g.agg(F.max("last_year").alias("newest"))
    return g.join(F.broadcast(newest)).select("k", "n", "last_year", ((F.col("last_year") <= F.col("newest") - 2) & (F.col("n") == 1)).alias("stale"))


@query("history_order_check", "SELECT o_custkey AS k, count(*) AS violations FROM (SELECT o_custkey, o_orderdate < lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS bad FROM orders) WHERE bad GROUP BY 1")
def history_order_check(t: Tables) -> DataFrame:
    bad = F.col("o_orderdate") < F.lag("o_orderdate").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t["orders"].select(F.col("o_custkey").alias("k"), bad.alias("bad")).where("bad").groupBy("k").agg(F.count("*").alias("violations"))


@query("venue_shadow_summary", with_views(PAGES_SQL, body="SELECT venue, count(*) AS n, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.9), 6) AS p90, round(avg(CASE WHEN s > 50000 THEN 1.0 ELSE 0.0 END), 6) AS anomalous FROM (SELECT venue, paper, avg(price) AS s FROM pages_ GROUP BY 1, 2) GROUP BY venue"))
def venue_shadow_summary(t: Tables) -> DataFrame:
    s = cut(t.pages.groupBy("venue", "paper").agg(F.avg("price").alias("s")))
    odd = s.groupBy("venue").agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("s") > 50000, 1.0).otherwise(0.0))).alias("anomalous"))
    both = joined(odd, percentiles(s, ["venue"], (0.5, 0.9), "s").drop("n"), ["venue"])
    return both.select("venue", "n", r6(F.col("p")[0]).alias("median"), r6(F.col("p")[1]).alias("p90"), "anomalous")


#: Weights of log defects.
SEV_ROWS = [("overfull", 1.696), ("underfull", 0.737), ("vbox_over", 0.737), ("vbox_under", 1.033), ("floatwarn", 1.033), ("warning", 0.3)]
SEV = "sev_(kind, w) AS (VALUES " + ", ".join(f"('{k}', {w})" for k, w in SEV_ROWS) + ")"


@query("defect_score", with_views(LOGS_SQL, ISSUE, SEV, body="SELECT doc, round(sum(w * CASE WHEN coalesce(amount, 0) > 50 THEN 1.0 ELSE 0.6 END), 4) AS score FROM issue_ JOIN sev_ USING (kind) GROUP BY doc"))
def defect_score(t: Tables) -> DataFrame:
    """Weighted count of defects, with a severity factor."""
    j = issues(t).join(F.broadcast(t.spark.createDataFrame(SEV_ROWS, "kind string, w double")), "kind")  # a fixed table of six rows
    return j.groupBy("doc").agg(F.round(F.sum(F.col("w") * F.when(F.coalesce("amount", F.lit(0.0)) > 50, 1.0).otherwise(0.6)), 4).alias("score"))


@query("unattributed_items", with_views(LOGS_SQL, ISSUE, body="SELECT doc, kind, count(*) AS n FROM issue_ WHERE line_lo IS NULL AND kind <> 'other' GROUP BY doc, kind"))
def unattributed_items(t: Tables) -> DataFrame:
    return issues(t).where("line_lo is null and kind <> 'other'").groupBy("doc", "kind").agg(F.count("*").alias("n"))


@query("issue_pages", with_views(LOGS_SQL, ISSUE, SEV, body="SELECT doc, page, n, round(p, 4) AS p FROM (SELECT doc, CAST(floor(line_lo / 100.0) AS BIGINT) AS page, count(*) AS n, sum(w) AS p FROM issue_ JOIN sev_ USING (kind) GROUP BY 1, 2)"))
def issue_pages(t: Tables) -> DataFrame:
    """Defect weight by page; items without a line stay under a null page."""
    j = issues(t).join(F.broadcast(t.spark.createDataFrame(SEV_ROWS, "kind string, w double")), "kind")
    return j.groupBy("doc", F.floor(F.col("line_lo") / 100.0).alias("page")).agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("p"))


@query("line_defects", with_views(LINES_SQL, body="SELECT doc, line, kind FROM (SELECT doc, line, unnest([CASE WHEN length(text) > 900 THEN 'giant' END, CASE WHEN length(text) = 0 THEN 'blank' END, CASE WHEN length(text) BETWEEN 1 AND 8 THEN 'stranded' END]) AS kind FROM lines_) WHERE kind IS NOT NULL"))
def line_defects(t: Tables) -> DataFrame:
    n = F.length("text")
    return t.lines.select("doc", "line", F.explode(F.array_compact(F.array(F.when(n > 900, "giant"), F.when(n == 0, "blank"), F.when((n >= 1) & (n <= 8), "stranded")))).alias("kind"))


@query("line_summary", with_views(LINES_SQL, body="SELECT doc, count(*) AS n, round(avg(length(text)), 6) AS ink_mean, min(length(text)) AS ink_min, max(length(text)) AS ink_max, CASE WHEN max(length(text)) > 900 THEN 'high' WHEN min(length(text)) BETWEEN 1 AND 8 THEN 'low' ELSE 'none' END AS severity FROM lines_ GROUP BY doc"))
def line_summary(t: Tables) -> DataFrame:
    n = F.length("text")
    return t.lines.groupBy("doc").agg(F.count("*").alias("n"), r6(F.avg(n)).alias("ink_mean"), F.min(n).cast("long").alias("ink_min"), F.max(n).cast("long").alias("ink_max"), F.when(F.max(n) > 900, "high").when((F.min(n) >= 1) & (F.min(n) <= 8), "low").otherwise("none").alias("severity"))


@query("reasonableness", "SELECT p_brand, n, CASE WHEN n < p25 THEN 'below' WHEN n > p75 THEN 'above' ELSE 'in_band' END AS place FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), (SELECT quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.75) AS p75 FROM (SELECT count(*) AS n FROM part GROUP BY p_brand))")
def reasonableness(t: Tables) -> DataFrame:
    c = t["part"].groupBy("p_brand").agg(F.count("*").alias("n"))
    q = c.agg(F.percentile("n", 0.25).alias("p25"), F.percentile("n", 0.75).alias("p75"))
    return c.join(F.broadcast(q)).select("p_brand", "n", F.when(F.col("n") < F.col("p25"), "below").when(F.col("n") > F.col("p75"), "above").otherwise("in_band").alias("place"))


SOFT = "least(3.0, CASE WHEN {x} < {t} THEN {w} * (1 - exp(-0.5 * (({t} - {x}) / {a}) ** 2)) ELSE {w} * (1 - exp(-0.5 * (({x} - {t}) / {b}) ** 2)) END)"
SOFT_A, SOFT_B = SOFT.format(x="quantity", t="25.0", w="1.0", a="10.0", b="8.0"), SOFT.format(x="discount", t="0.05", w="2.0", a="0.03", b="0.02")


def soft(t: Tables) -> DataFrame:
    f = F.lit
    a = scalar.soft_loss(F.col("quantity"), f(25.0), f(10.0), f(8.0), f(1.0))
    b = scalar.soft_loss(F.col("discount"), f(0.05), f(0.03), f(0.02), f(2.0))
    return t.pages.select("paper", "page", a.alias("a"), b.alias("b"))


@query("soft_loss", with_views(PAGES_SQL, body=f"SELECT paper, page, round({SOFT_A}, 6) AS quantity_loss, round({SOFT_B}, 6) AS discount_loss FROM pages_"))
def soft_loss(t: Tables) -> DataFrame:
    return soft(t).select("paper", "page", r6("a").alias("quantity_loss"), r6("b").alias("discount_loss"))


@query("page_soft_score", with_views(PAGES_SQL, body=f"SELECT paper, page, round({SOFT_A} + {SOFT_B}, 6) AS score FROM pages_"))
def page_soft_score(t: Tables) -> DataFrame:
    return soft(t).select("paper", "page", r6(F.col("a") + F.col("b")).alias("score"))


@query("asoft_doc", with_views(PAGES_SQL, f"s_ AS (SELECT paper, {SOFT_A} + {SOFT_B} AS s FROM pages_)", body="SELECT paper, round(0.5 * avg(s) FILTER (WHERE r <= k) + 0.5 * avg(s), 5) AS score FROM (SELECT paper, s, row_number() OVER (PARTITION BY paper ORDER BY s DESC) AS r, greatest(1, round_even(0.05 * count(*) OVER (PARTITION BY paper), 0)) AS k FROM s_) GROUP BY paper"))
def asoft_doc(t: Tables) -> DataFrame:
    from foliometry.operators.profiles import pooled

    return pooled(soft(t).select("paper", (F.col("a") + F.col("b")).alias("s")), ["paper"], "s").select("paper", F.round("pooled", 5).alias("score"))


@query("pixel_centroid", "SELECT o_orderkey, CASE WHEN o_custkey % 20 - 2 >= 0 THEN round(1 - (0.25 * (o_custkey % 20 - 2) + 0.75) / (o_custkey % 20 - 1), 4) END AS centre FROM orders")
def pixel_centroid(t: Tables) -> DataFrame:
    return t["orders"].select("o_orderkey", scalar.pixel_centroid((F.col("o_custkey") % 20 - 2).cast("double")).alias("centre"))


@query("unit_convert", "SELECT p_partkey, round(p_size * CASE p_partkey % 4 WHEN 0 THEN 72.27 / 25.4 WHEN 1 THEN 72.27 / 2.54 WHEN 2 THEN 72.27 ELSE 1.0 END, 6) AS pt FROM part")
def unit_convert(t: Tables) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("mm", "cm", "in", "pt"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t["part"].select("p_partkey", r6(scalar.length_in(F.concat(F.col("p_size").cast("string"), F.lit(".0"), unit), scalar.PT)).alias("pt"))


SIZES = "[" + ", ".join(map(str, scalar.STANDARD_SIZES)) + "]"


@query("snap_size", f"SELECT p_partkey, coalesce(list_filter({SIZES}, lambda s: abs(v - s) <= 0.6)[1], round(v, 1))::DOUBLE AS size FROM (SELECT p_partkey, p_size / 2.0 + 0.25 AS v FROM part)")
def snap_size(t: Tables) -> DataFrame:
    return t["part"].select("p_partkey", scalar.snap_size(F.col("p_size") / 2.0 + 0.25).alias("size"))


@query("paper_size_class", "SELECT p_partkey, CASE WHEN abs(w - 612) <= 6 AND abs(h - 792) <= 6 THEN 'letter' WHEN abs(w - 595.28) <= 6 AND abs(h - 841.89) <= 6 THEN 'a4' ELSE 'custom' END AS class FROM (SELECT p_partkey, 590.0 + p_size AS w, 790.0 + p_partkey % 60 AS h FROM part)")
def paper_size_class(t: Tables) -> DataFrame:
    return t["part"].select("p_partkey", scalar.paper_size_class(590.0 + F.col("p_size"), 790.0 + F.col("p_partkey") % 60).alias("class"))


@query("text_area", "SELECT p_partkey, round(greatest(210.0 - 2 * p_size, 20), 6) AS width_mm, round(greatest(297.0 - 2 * p_size, 20), 6) AS height_mm FROM part")
def text_area(t: Tables) -> DataFrame:
    side = lambda mm: r6(F.greatest(mm - 2.0 * F.col("p_size"), F.lit(20.0)))
    return t["part"].select("p_partkey", side(210.0).alias("width_mm"), side(297.0).alias("height_mm"))


@query("guarded_ratios", "SELECT o_orderkey, round(CASE WHEN n > 0 THEN q / n END, 6) AS qty_per_line, round(CASE WHEN n > 3 THEN q / p END, 9) AS gap FROM (SELECT o_orderkey, count(l_orderkey) AS n, sum(l_quantity) AS q, max(o_totalprice) AS p FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def guarded_ratios(t: Tables) -> DataFrame:
    """Guarded ratios."""
    li = t["lineitem"].groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    j = t["orders"].join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", r6(F.when(F.col("n") > 0, F.col("q") / F.col("n"))).alias("qty_per_line"), F.round(F.when(F.col("n") > 3, F.col("q") / F.col("o_totalprice")), 9).alias("gap"))


@query("density_per_page", with_views(PAGES_SQL, body="SELECT paper, round(sum(quantity) / count(*), 6) AS quantity, round(sum(discount) / count(*), 6) AS discount FROM pages_ GROUP BY paper HAVING count(*) > 0"))
def density_per_page(t: Tables) -> DataFrame:
    return t.pages.groupBy("paper").agg(r6(F.sum("quantity") / F.count("*")).alias("quantity"), r6(F.sum("discount") / F.count("*")).alias("discount"))


@query("event_ranges", "SELECT event_id, error FROM (SELECT event_id, unnest([CASE WHEN event_type = 'error' THEN 'unknown action' END, CASE WHEN value < 1 THEN 'below range' END, CASE WHEN value > 100 THEN 'above range' END]) AS error FROM events) WHERE error IS NOT NULL")
def event_ranges(t: Tables) -> DataFrame:
    """Violations of the rule table: unknown action, value out of range."""
    v = F.col("value")
    return t["events"].select("event_id", F.explode(F.array_compact(F.array(F.when(F.col("event_type") == "error", "unknown action"), F.when(v < 1, "below range"), F.when(v > 100, "above range")))).alias("error"))


@query("doc_schema_check", "SELECT 'duplicate' AS rule, CAST(l_orderkey AS VARCHAR) || ':' || l_linenumber AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'role', CAST(event_id AS VARCHAR) FROM events WHERE event_type NOT IN ('click', 'view', 'error', 'signup')")
def doc_schema_check(t: Tables) -> DataFrame:
    dup = t["lineitem"].groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("rule"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("detail"))
    role = t["events"].where(~F.col("event_type").isin("click", "view", "error", "signup")).select(F.lit("role").alias("rule"), F.col("event_id").cast("string").alias("detail"))
    return dup.unionByName(role)


@query("missing_fields", "SELECT doc_id, field FROM (SELECT d.doc_id, unnest([CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END]) AS field FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE field IS NOT NULL")
def missing_fields(t: Tables) -> DataFrame:
    from foliometry.operators.flatten import missing_fields as missing

    return missing(t["documents"].select("doc_id").join(t["labels"], "doc_id", "left"), ["doc_id"], ["quality", "toxic"])


@query("legacy_adapt", "SELECT doc_id, n_chars AS chars, CASE WHEN n_chars > 500 THEN 'ok' ELSE 'partial' END AS status FROM documents")
def legacy_adapt(t: Tables) -> DataFrame:
    """Old flat rows as the nested schema with status labels, read back flat."""
    nested = t["documents"].select("doc_id", F.struct(F.col("n_chars").alias("chars"), F.when(F.col("n_chars") > 500, "ok").otherwise("partial").alias("status")).alias("density"))
    return nested.select("doc_id", "density.chars", "density.status")


@query("accept_verdict", with_views(VERSIONS, body="SELECT n, round(old_median, 6) AS old_median, round(new_median, 6) AS new_median, new_median <= old_median AND new_worst <= old_worst AS accepted FROM (SELECT count(*) AS n, quantile_cont(m1, 0.5) AS old_median, quantile_cont(m1 + 0.1 * m2, 0.5) AS new_median, max(m1) AS old_worst, max(m1 + 0.1 * m2) AS new_worst FROM v_)"))
def accept_verdict(t: Tables) -> DataFrame:
    """New scores are accepted only if neither the median nor the worst is worse."""
    new = F.col("m1") + 0.1 * F.col("m2")
    side = lambda name, c: F.struct(F.lit(name).alias("side"), c.alias("v"))
    sides = versions(t).select(F.explode(F.array(side("old", F.col("m1")), side("new", new))).alias("s")).select("s.*")
    both = joined(sides.groupBy("side").agg(F.count("*").alias("n"), F.max("v").alias("worst")), percentiles(sides, ["side"], (0.5,), "v").drop("n"), ["side"])
    of = lambda name, c, out: F.max(F.when(F.col("side") == name, c)).alias(out)
    g = both.agg(F.max("n").alias("n"), of("old", F.col("p")[0], "a"), of("new", F.col("p")[0], "b"), of("old", F.col("worst"), "wa"), of("new", F.col("worst"), "wb"))
    return g.select("n", r6("a").alias("old_median"), r6("b").alias("new_median"), ((F.col("b") <= F.col("a")) & (F.col("wb") <= F.col("wa"))).alias("accepted"))


@query("brand_template", """WITH m AS (SELECT p_brand, quantile_cont(p_size, 0.25) AS p25, quantile_cont(p_size, 0.5) AS p50, quantile_cont(p_size, 0.75) AS p75, count(*) AS n FROM part GROUP BY 1),
o AS (SELECT p_brand, min(p_size) AS official FROM part WHERE p_type = 'PROMO' AND p_size > 20 GROUP BY 1)
SELECT m.p_brand, coalesce(CAST(official AS DOUBLE), p50) AS target, CASE WHEN official IS NULL THEN 'sample' ELSE 'official' END AS basis, p25 AS low, p75 AS high, n >= 16 AS reliable FROM m LEFT JOIN o USING (p_brand)""")
def brand_template(t: Tables) -> DataFrame:
    """One row a venue: the official value, else the sample's median, with the usual range and whether it is reliable."""
    q = F.percentile("p_size", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    m = t["part"].groupBy("p_brand").agg(q.alias("q"), F.count("*").alias("n"))
    o = t["part"].where("p_type = 'PROMO' and p_size > 20").groupBy("p_brand").agg(F.min("p_size").cast("double").alias("official"))
    j = m.join(o, "p_brand", "left")
    return j.select("p_brand", F.coalesce("official", F.col("q")[1]).alias("target"), F.when(F.col("official").isNull(), "sample").otherwise("official").alias("basis"), F.col("q")[0].alias("low"), F.col("q")[2].alias("high"), (F.col("n") >= 16).alias("reliable"))
