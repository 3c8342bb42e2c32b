"""Queries of profiles and grouped statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliometry.functions import scalar
from foliometry.functions.scalar import nearest6, r6
from foliometry.operators import aggregates as agg
from foliometry.operators import flatten, profiles
from foliometry.operators.lineage import cut
from foliometry.operators.quantiles import joined, percentiles, wide_percentiles
from foliometry.plans.registry import DIMS, LONG_SQL, PAGES_SQL, Tables, query, with_views

P = "round(quantile_cont({v}, {q}), 6)"
QUANT = ", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for q, n in ((0.1, "p10"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90")))


@query("flatten_metrics", with_views(LONG_SQL, body="SELECT paper, page, dim, value FROM long_"))
def flatten_metrics(t: Tables) -> DataFrame:
    return t.long.select("paper", "page", "dim", "value")


@query("renest_metrics", with_views(PAGES_SQL, body=f"SELECT paper, page, {', '.join(DIMS)} FROM pages_"))
def renest_metrics(t: Tables) -> DataFrame:
    return flatten.to_wide(t.long, ["paper", "page"], DIMS)


@query("quantile_linear", with_views(LONG_SQL, body=f"SELECT dim, role, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, {QUANT} FROM long_ GROUP BY dim, role"))
def quantile_linear(t: Tables) -> DataFrame:
    return agg.quantiles(t.long, ["dim", "role"])


@query("descriptive_stats", f"SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, {QUANT} FROM events GROUP BY event_type")
def descriptive_stats(t: Tables) -> DataFrame:
    return agg.quantiles(t["events"], ["event_type"])


def _at(expr: str) -> str:
    return f"list_sort(list(value))[CAST({expr} AS BIGINT) + 1]"


@query("quantile_floor_index", with_views(LONG_SQL, body=f"SELECT paper, dim, count(*) AS n, {_at('least(count(*) - 1, floor(count(*) * 0.1))')} AS p10, {_at('least(count(*) - 1, floor(count(*) * 0.9))')} AS p90 FROM long_ GROUP BY paper, dim"))
def quantile_floor_index(t: Tables) -> DataFrame:
    return agg.at_ranks(t.long, ["paper", "dim"], {"p10": agg.floor_rank(0.1), "p90": agg.floor_rank(0.9)})


@query("quantile_round_index", with_views(LONG_SQL, body=f"SELECT paper, dim, count(*) AS n, {_at('round_even(0.05 * (count(*) - 1), 0)')} AS p05, {_at('round_even(0.95 * (count(*) - 1), 0)')} AS p95 FROM long_ GROUP BY paper, dim"))
def quantile_round_index(t: Tables) -> DataFrame:
    return agg.at_ranks(t.long, ["paper", "dim"], {"p05": agg.round_rank(0.05), "p95": agg.round_rank(0.95)})


@query("quantile_lower_upper_index", with_views(LONG_SQL, body=f"SELECT paper, dim, count(*) AS n, {_at('floor(count(*) * 0.025)')} AS lo, {_at('floor(count(*) * 0.975)')} AS hi FROM long_ GROUP BY paper, dim"))
def quantile_lower_upper_index(t: Tables) -> DataFrame:
    return agg.at_ranks(t.long, ["paper", "dim"], {"lo": agg.truncated_rank(0.025), "hi": agg.truncated_rank(0.975)})


@query("upper_median", with_views(LONG_SQL, body=f"SELECT paper, dim, count(*) AS n, {_at('floor(count(*) / 2.0)')} AS median FROM long_ GROUP BY paper, dim"))
def upper_median(t: Tables) -> DataFrame:
    return agg.at_ranks(t.long, ["paper", "dim"], {"median": agg.upper_median_rank()})


@query("mode_tie", """
WITH c AS (SELECT p_brand, p_size, count(*) AS c FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY c DESC, CAST(p_size AS VARCHAR)) AS k, sum(c) OVER (PARTITION BY p_brand) AS n, count(*) OVER (PARTITION BY p_brand) AS kinds FROM c)
SELECT p_brand, CAST(p_size AS VARCHAR) AS mode, c AS mode_count, CAST(n AS BIGINT) AS n, kinds = 1 AS consistent FROM r WHERE k = 1""")
def mode_tie(t: Tables) -> DataFrame:
    return agg.mode(t["part"], ["p_brand"], "p_size")


@query("mode_binned", """
WITH b AS (SELECT event_type, value, CAST(round_even(value / 5.0, 0) AS BIGINT) AS bin FROM events WHERE value IS NOT NULL), c AS (SELECT event_type, bin, count(*) AS c FROM b GROUP BY 1, 2),
top AS (SELECT event_type, bin AS top FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY c DESC, bin) AS k FROM c) WHERE k = 1)
SELECT event_type, round(avg(value), 4) AS mode_value, count(*) AS n_near FROM b JOIN top USING (event_type) WHERE abs(value - top * 5.0) <= 5.0 GROUP BY event_type""")
def mode_binned(t: Tables) -> DataFrame:
    return agg.mode_binned(t["events"], ["event_type"], "value", 5.0)


@query("mode_weighted", """
WITH s AS (SELECT source, lang, sum(n_chars) AS w FROM documents GROUP BY 1, 2)
SELECT source, lang AS mode_value, CAST(w AS BIGINT) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, lang) AS k FROM s) WHERE k = 1""")
def mode_weighted(t: Tables) -> DataFrame:
    return agg.mode_weighted(t["documents"], ["source"], "lang", "n_chars")


@query("spread_cv", with_views(LONG_SQL, body="SELECT paper, dim, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN stddev_pop(value) END, 6) AS std, round(CASE WHEN count(*) >= 2 AND avg(value) <> 0 THEN stddev_pop(value) / avg(value) END, 6) AS cv FROM long_ GROUP BY paper, dim"))
def spread_cv(t: Tables) -> DataFrame:
    return agg.spread(t.long, ["paper", "dim"])


TOP = """top_ AS (SELECT paper, dim, n, k, mean, avg(value) FILTER (WHERE r <= k) AS top_mean FROM (
  SELECT paper, dim, value, row_number() OVER (PARTITION BY paper, dim ORDER BY value DESC) AS r, count(*) OVER w AS n, avg(value) OVER w AS mean, CAST(greatest(1, round_even(0.05 * count(*) OVER w, 0)) AS BIGINT) AS k FROM long_ WINDOW w AS (PARTITION BY paper, dim)) GROUP BY paper, dim, n, k, mean)"""


@query("topk_mean", with_views(LONG_SQL, TOP, body="SELECT paper, dim, n, k, round(top_mean, 9) AS top_mean FROM top_"))
def topk_mean(t: Tables) -> DataFrame:
    return agg.top_share(t.long, ["paper", "dim"]).select("paper", "dim", "n", "k", F.round("top_mean", 9).alias("top_mean"))


@query("pooled_cvar", with_views(LONG_SQL, TOP, body="SELECT paper, dim, round(0.5 * top_mean + 0.5 * mean, 8) AS pooled FROM top_"))
def pooled_cvar(t: Tables) -> DataFrame:
    return profiles.pooled(t.long, ["paper", "dim"], "value").select("paper", "dim", F.round("pooled", 8).alias("pooled"))


TIER = "CASE WHEN count(DISTINCT paper) >= 36 THEN 'high' WHEN count(DISTINCT paper) >= 16 THEN 'medium' ELSE 'low' END AS tier"
LEVEL = "dim, count(*) AS n, count(DISTINCT paper) AS n_papers, round(avg(value), 7) AS mean, " + QUANT + ", " + TIER + " FROM long_"


@query("profile_levels", with_views(LONG_SQL, body=f"""SELECT 'venue_role' AS level, CAST(venue AS VARCHAR) || '|' || role AS key, {LEVEL} WHERE venue IS NOT NULL GROUP BY venue, role, dim
UNION ALL SELECT 'role', role, {LEVEL} GROUP BY role, dim UNION ALL SELECT 'venue', CAST(venue AS VARCHAR), {LEVEL} WHERE venue IS NOT NULL GROUP BY venue, dim"""))
def profile_levels(t: Tables) -> DataFrame:
    return profiles.profile_levels(t.long)


ROLL = "dim, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 9) AS mean, round(max(value), 6) AS max, round(quantile_cont(value, 0.9), 6) AS p90 FROM long_"


@query("paper_rollup", with_views(LONG_SQL, body=f"SELECT paper, 'all' AS role, {ROLL} GROUP BY paper, dim UNION ALL SELECT paper, role, {ROLL} GROUP BY paper, role, dim"))
def paper_rollup(t: Tables) -> DataFrame:
    return profiles.rollup(t.pages, DIMS)


@query("status_coverage", "SELECT o_orderpriority AS grp, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def status_coverage(t: Tables) -> DataFrame:
    return t["orders"].groupBy(F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("metric_coverage", with_views(LONG_SQL, body="SELECT dim, role, count(value) AS n, count(*) FILTER (WHERE abs(value) > 1e-12) AS n_nonzero, round(count(*) FILTER (WHERE abs(value) > 1e-12) / count(value), 6) AS share_nonzero FROM long_ GROUP BY dim, role"))
def metric_coverage(t: Tables) -> DataFrame:
    return agg.coverage(t.long, ["dim", "role"])


@query("band_hit_rate", with_views(LONG_SQL, body="""SELECT dim, count(value) AS n, round(avg(CASE WHEN value < lo THEN 1.0 ELSE 0.0 END), 6) AS below, round(avg(CASE WHEN value BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS inside, round(avg(CASE WHEN value > hi THEN 1.0 ELSE 0.0 END), 6) AS above
FROM long_ JOIN (VALUES ('quantity', 10.0, 40.0), ('discount', 0.02, 0.08), ('tax', 0.01, 0.05)) b(dim, lo, hi) USING (dim) GROUP BY dim"""))
def band_hit_rate(t: Tables) -> DataFrame:
    bands = t.spark.createDataFrame([("quantity", 10.0, 40.0), ("discount", 0.02, 0.08), ("tax", 0.01, 0.05)], "dim string, lo double, hi double")
    return agg.band_hits(t.long, bands, ["dim"])


@query("metric_health", with_views(LONG_SQL, body="""SELECT dim, count(*) AS n, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
round(stddev_pop(value), 6) AS sd, round(stddev_pop(value) / avg(value), 6) AS cv, round(avg(CASE WHEN abs(value) < 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS near_zero FROM long_ GROUP BY dim"""))
def metric_health(t: Tables) -> DataFrame:
    v = F.col("value")
    p = percentiles(t.long, ["dim"], (0.05, 0.5, 0.95, 0.99)).select("dim", *[nearest6(F.col("p")[k]).alias(c) for k, c in enumerate(("p5", "p50", "p95", "p99"))])
    g = t.long.groupBy("dim").agg(F.count("*").alias("n"), r6(F.stddev_pop(v)).alias("sd"), r6(F.stddev_pop(v) / F.avg(v)).alias("cv"), r6(F.avg(F.when(F.abs(v) < 1e-6, 1.0).otherwise(0.0))).alias("near_zero"))
    return g.join(p, "dim")


@query("metric_version_compare", with_views(PAGES_SQL, body="""SELECT role, round(quantile_cont(price, 0.5), 6) AS old_p50, round(quantile_cont(net_price, 0.5), 6) AS new_p50, round(quantile_cont(price, 0.9), 6) AS old_p90, round(quantile_cont(net_price, 0.9), 6) AS new_p90,
round(max(price), 6) AS old_max, round(max(net_price), 6) AS new_max, round(avg(CASE WHEN price <> net_price THEN 1.0 ELSE 0.0 END), 6) AS changed FROM pages_ GROUP BY role"""))
def metric_version_compare(t: Tables) -> DataFrame:
    pages = cut(t.pages.select("role", "price", "net_price"))
    out = pages.groupBy("role").agg(r6(F.max("price")).alias("old_max"), r6(F.max("net_price")).alias("new_max"), r6(F.avg(F.when(F.col("price") != F.col("net_price"), 1.0).otherwise(0.0))).alias("changed"))
    p = wide_percentiles(pages, ["role"], ["price", "net_price"], (0.5, 0.9))
    for version, column in (("old", "price"), ("new", "net_price")):
        own = p.where(F.col("dim") == column).select("role", *[nearest6(F.col("p")[k]).alias(f"{version}_{c}") for k, c in enumerate(("p50", "p90"))])
        out = joined(out, own, ["role"], "left")
    return out


@query("hygiene_rates", "SELECT source, count(*) AS n, round(avg(CASE WHEN contains(text, '@') THEN 1.0 ELSE 0.0 END), 6) AS with_at, round(avg(CASE WHEN contains(text, '|') THEN 0.0 ELSE 1.0 END), 6) AS lacks_bar, quantile_cont(n_chars, 0.5) AS median_chars FROM documents GROUP BY source")
def hygiene_rates(t: Tables) -> DataFrame:
    has = lambda s: F.when(F.col("text").contains(s), 1.0).otherwise(0.0)
    median = percentiles(t["documents"], ["source"], (0.5,), "n_chars").select("source", F.col("p")[0].alias("median_chars"))
    return t["documents"].groupBy("source").agg(F.count("*").alias("n"), r6(F.avg(has("@"))).alias("with_at"), r6(F.avg(1.0 - has("|"))).alias("lacks_bar")).join(median, "source")


BLOCK = """block_ AS (SELECT role, dim, n, p50 AS center, CASE WHEN p75 - p25 > 1e-9 THEN p75 - p25 WHEN p90 - p10 > 1e-9 THEN (p90 - p10) / 2.563 ELSE 1e-6 END AS scale,
  CASE WHEN p75 - p25 < 0.1 * (p90 - p10) THEN p10 ELSE p25 END AS lo, CASE WHEN p75 - p25 < 0.1 * (p90 - p10) THEN p90 ELSE p75 END AS hi
  FROM (SELECT role, dim, count(*) AS n, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90 FROM long_ GROUP BY role, dim))"""
LOSS = "loss_ AS (SELECT paper, page, role, dim, CASE WHEN value > hi THEN (value - hi) / scale WHEN value < lo THEN 1.2 * (lo - value) / scale ELSE 0.0 END AS loss FROM long_ JOIN block_ USING (role, dim))"
NORM = "norm_ AS (SELECT *, least(loss / greatest(ref, 1e-6), 20.0) AS norm FROM loss_ JOIN (SELECT role, dim, quantile_cont(loss, 0.9) AS ref FROM loss_ GROUP BY role, dim) USING (role, dim))"
POOL = TOP.replace("top_ AS", "pool_ AS").replace("FROM long_", "FROM norm_").replace("value", "norm")


@query("robust_block", with_views(LONG_SQL, BLOCK, body="SELECT role, dim, n, round(center, 6) AS center, round(scale, 6) AS scale, round(lo, 6) AS lo, round(hi, 6) AS hi FROM block_"))
def robust_block(t: Tables) -> DataFrame:
    return profiles.wide_block(t.pages, ["role"], DIMS).select("role", "dim", "n", *[nearest6(c).alias(c) for c in ("center", "scale", "lo", "hi")])


@query("band_loss", with_views(LONG_SQL, BLOCK, LOSS, body="SELECT paper, page, dim, round(loss, 6) AS loss FROM loss_"))
def band_loss(t: Tables) -> DataFrame:
    return profiles.page_losses(t.kept, profiles.wide_block(t.written, ["role"], DIMS), ["role"]).select("paper", "page", "dim", nearest6("loss").alias("loss"))


@query("norm_loss", with_views(LONG_SQL, BLOCK, LOSS, NORM, body="SELECT paper, page, dim, round(norm, 6) AS norm FROM norm_"))
def norm_loss(t: Tables) -> DataFrame:
    losses = profiles.page_losses(t.kept, profiles.robust_block(t.kept, ["role"]), ["role"])
    return profiles.normalise(losses, ["role"]).select("paper", "page", "dim", nearest6("norm").alias("norm"))


@query("page_loss_rows", with_views(LONG_SQL, BLOCK, LOSS, NORM, body="SELECT paper, page, count(*) AS n_dims, round(sum(norm), 5) AS total FROM norm_ GROUP BY paper, page HAVING count(*) >= 3"))
def page_loss_rows(t: Tables) -> DataFrame:
    """Measures and total normalised loss of each page, of every role, with three measures or more; the bands of a role are one row, so no page is copied or shuffled."""
    norms = profiles.wide_norms(t.written, t.kept, ["paper", "page"], ["role"], DIMS)
    n, total = (sum((F.when(F.col(d).isNotNull(), x(F.col(d))).otherwise(zero) for d in DIMS), F.lit(zero)) for x, zero in ((lambda _: F.lit(1), 0), (lambda v: v, 0.0)))
    return norms.select("paper", "page", n.cast("long").alias("n_dims"), F.round(total, 5).alias("total")).where("n_dims >= 3")


WEIGHTS = {"quantity": 1.0, "price": 0.5, "discount": 2.0, "tax": 1.0, "unit_price": 0.75, "net_price": 0.25}
WEIGHT_SQL = "w_(dim, w) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items()) + ")"
SCORE = "score_ AS (SELECT paper, count(*) AS n_dims, sum(w * (0.5 * top_mean + 0.5 * mean)) / sum(w) AS score FROM pool_ JOIN w_ USING (dim) GROUP BY paper)"


@query("weighted_profile_score", with_views(LONG_SQL, BLOCK, LOSS, NORM, POOL, WEIGHT_SQL, SCORE, body="SELECT paper, n_dims, round(score, 5) AS score FROM score_"))
def weighted_profile_score(t: Tables) -> DataFrame:
    return profiles.paper_scores(t.kept, ["role"], WEIGHTS).select("paper", "n_dims", F.round("score", 5).alias("score"))


@query("flagship", with_views(LONG_SQL, BLOCK, LOSS, NORM, POOL, WEIGHT_SQL, SCORE, body="SELECT paper, round(score, 5) AS score FROM score_ ORDER BY score_.score DESC, paper LIMIT 20"))
def flagship(t: Tables) -> DataFrame:
    """The twenty papers that are furthest from the profile of their pages' roles."""
    scores = profiles.paper_scores(t.kept, ["role"], WEIGHTS)
    return scores.orderBy(F.desc("score"), "paper").limit(20).select("paper", F.round("score", 5).alias("score"))


@query("category_ratio", "SELECT *, round(total / sum(total) OVER (PARTITION BY source), 6) AS share FROM (SELECT source, lang, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY 1, 2)")
def category_ratio(t: Tables) -> DataFrame:
    return agg.category_shares(t["documents"], ["source"], "lang", "n_chars")


@query("rate_by_group", "SELECT source, count(*) AS n, round(avg(quality), 6) AS rate FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY source")
def rate_by_group(t: Tables) -> DataFrame:
    rows = t["documents"].select("doc_id", "source").join(t["labels"], "doc_id").withColumn("good", F.col("quality") == 1)
    return agg.rate(rows, ["source"], "good")


@query("defect_frequency", """
WITH d AS (SELECT user_id AS paper, event_type AS defect, count(*) AS hits FROM events GROUP BY 1, 2), n AS (SELECT count(DISTINCT user_id) AS papers, count(*) AS pages FROM events)
SELECT defect, round(100.0 * count(*) / max(papers), 6) AS incidence_pct, round(sum(hits) / max(papers), 6) AS mean_hits, quantile_cont(hits, 0.5) AS p50, quantile_cont(hits, 0.9) AS p90, round(100.0 * sum(hits) / max(pages), 6) AS per_100_pages FROM d, n GROUP BY defect""")
def defect_frequency(t: Tables) -> DataFrame:
    e = t["events"]
    d = e.groupBy(F.col("user_id").alias("paper"), F.col("event_type").alias("defect")).agg(F.count("*").alias("hits"))
    n = e.agg(F.count_distinct("user_id").alias("papers"), F.count("*").alias("pages"))
    g = d.join(F.broadcast(n)).groupBy("defect")  # n is one row
    p = percentiles(d, ["defect"], (0.5, 0.9), "hits").select("defect", *[F.col("p")[k].alias(c) for k, c in enumerate(("p50", "p90"))])
    return g.agg(
        r6(100.0 * F.count("*") / F.max("papers")).alias("incidence_pct"), r6(F.sum("hits") / F.max("papers")).alias("mean_hits"), r6(100.0 * F.sum("hits") / F.max("pages")).alias("per_100_pages"),
    ).join(p, "defect")


@query("defect_amplitude", "SELECT event_type, count(*) AS n, round(quantile_cont(a, 0.5), 6) AS p50, round(quantile_cont(a, 0.9), 6) AS p90, round(avg(CASE WHEN a >= 50 THEN 1.0 ELSE 0.0 END), 6) AS share_high FROM (SELECT event_type, unnest(amps) AS a FROM (SELECT user_id, event_type, list(value) AS amps FROM events GROUP BY 1, 2)) GROUP BY event_type")
def defect_amplitude(t: Tables) -> DataFrame:
    amps = t["events"].groupBy("user_id", "event_type").agg(F.collect_list("value").alias("amps"))
    rows = amps.select("event_type", F.explode("amps").alias("a"))
    p = percentiles(rows, ["event_type"], (0.5, 0.9), "a").select("event_type", *[r6(F.col("p")[k]).alias(c) for k, c in enumerate(("p50", "p90"))])
    return p.join(rows.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("a") >= 50, 1.0).otherwise(0.0))).alias("share_high")), "event_type")


@query("defect_prevalence", "SELECT event_type AS defect, round(100.0 * count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 6) AS papers_pct, round(count(*) / (SELECT count(*) FROM events), 6) AS hits_per_page FROM events GROUP BY 1")
def defect_prevalence(t: Tables) -> DataFrame:
    e = t["events"]
    n = e.agg(F.count_distinct("user_id").alias("papers"), F.count("*").alias("pages"))
    g = e.groupBy(F.col("event_type").alias("defect")).agg(F.count_distinct("user_id").alias("p"), F.count("*").alias("h"))
    return g.join(F.broadcast(n)).select("defect", r6(100.0 * F.col("p") / F.col("papers")).alias("papers_pct"), r6(F.col("h") / F.col("pages")).alias("hits_per_page"))


@query("sample_stats", with_views(LONG_SQL, body="SELECT venue, dim, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, string_agg(DISTINCT CAST(paper AS VARCHAR), ',' ORDER BY CAST(paper AS VARCHAR)) AS papers FROM long_ GROUP BY venue, dim"))
def sample_stats(t: Tables) -> DataFrame:
    """Statistics of a venue's pages, and its papers. Pages are summed by paper first, so only papers meet by venue."""
    p = wide_percentiles(t.pages, ["venue"], DIMS, (0.5, 0.1, 0.9)).select("venue", "dim", *[nearest6(F.col("p")[k]).alias(c) for k, c in enumerate(("median", "p10", "p90"))])
    sums = t.pages.groupBy("paper", "venue").agg(*[F.struct(F.lit(d).alias("dim"), F.count(d).alias("n"), F.sum(F.col(d).cast("double")).alias("s")).alias(d) for d in DIMS])
    sums = sums.select("paper", "venue", F.explode(F.array(*DIMS)).alias("e")).select("paper", "venue", "e.*").where("n > 0")
    papers = F.array_join(F.sort_array(F.collect_list(F.col("paper").cast("string"))), ",")
    return joined(sums.groupBy("venue", "dim").agg(F.sum("n").alias("n"), r6(F.sum("s") / F.sum("n")).alias("mean"), papers.alias("papers")), p, ["venue", "dim"])


@query("venue_pattern_table", """SELECT p_brand, round(avg(p_size), 6) AS mean_size, quantile_cont(p_retailprice, 0.5) AS median_price, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, count(DISTINCT p_type) = 1 AS consistent FROM part GROUP BY p_brand""")
def venue_pattern_table(t: Tables) -> DataFrame:
    median = percentiles(t["part"], ["p_brand"], (0.5,), "p_retailprice").select("p_brand", F.col("p")[0].alias("median_price"))
    rows = t["part"].groupBy("p_brand").agg(r6(F.avg("p_size")).alias("mean_size"), F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"), (F.count_distinct("p_type") == 1).alias("consistent"))
    return joined(rows, median, ["p_brand"], "left")


@query("judge_transform", with_views(LONG_SQL, body="SELECT paper, page, dim, CASE WHEN dim IN ('price', 'net_price') AND value > -1 THEN round(ln(1 + value), 6) ELSE value END AS value FROM long_"))
def judge_transform(t: Tables) -> DataFrame:
    v = scalar.judge_transform(F.col("dim"), F.col("value"), ("price", "net_price"))
    return t.long.select("paper", "page", "dim", F.when(F.col("dim").isin("price", "net_price"), r6(v)).otherwise(v).alias("value"))


@query("robust_z", with_views(LONG_SQL, BLOCK, body="SELECT paper, page, dim, round(greatest(-4, least(4, (value - center) / scale)), 6) AS z FROM long_ JOIN block_ USING (role, dim)"))
def robust_z(t: Tables) -> DataFrame:
    rows = t.kept.join(profiles.robust_block(t.kept, ["role"]), ["role", "dim"])
    return rows.select("paper", "page", "dim", nearest6(scalar.robust_z(F.col("value"), F.col("center"), F.col("scale"))).alias("z"))


@query("confidence_tier", with_views(PAGES_SQL, body="SELECT venue, role, count(DISTINCT paper) AS n, CASE WHEN count(DISTINCT paper) >= 6 THEN 'high' WHEN count(DISTINCT paper) >= 3 THEN 'medium' ELSE 'low' END AS tier FROM pages_ GROUP BY venue, role"))
def confidence_tier(t: Tables) -> DataFrame:
    return t.pages.groupBy("venue", "role").agg(F.count_distinct("paper").alias("n")).withColumn("tier", scalar.confidence_tier(F.col("n"), 6, 3))


@query("worst_dims", with_views(LONG_SQL, BLOCK, LOSS, NORM, POOL, body="SELECT paper, dim, k FROM (SELECT paper, dim, row_number() OVER (PARTITION BY paper ORDER BY round(0.5 * top_mean + 0.5 * mean, 5) DESC, dim) AS k FROM pool_) WHERE k <= 3"))
def worst_dims(t: Tables) -> DataFrame:
    from foliometry.operators.windows import top_k

    losses = profiles.normalise(profiles.page_losses(t.kept, profiles.robust_block(t.kept, ["role"]), ["role"]), ["role"])
    pooled = profiles.pooled(losses, ["paper", "dim"], "norm").withColumn("p", F.round("pooled", 5))
    return top_k(pooled, ["paper"], [F.desc("p"), F.col("dim")], 3).select("paper", "dim", "k")
