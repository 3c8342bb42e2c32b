"""Queries of statistics: correlation groups, shrinkage, folds, false positives, weights, preferences, metric health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliometry.functions.scalar import corr, nearest6, r6
from foliometry.operators import evaluation, profiles, statistics, windows
from foliometry.operators.flatten import to_long
from foliometry.operators.lineage import cut
from foliometry.operators.quantiles import Parts, joined, percentiles, ranked, wide_percentiles
from foliometry.plans.profile_queries import BLOCK, LOSS, NORM, TOP, WEIGHT_SQL, WEIGHTS
from foliometry.plans.registry import DIMS, LONG_SQL, PAGES_SQL, Tables, query, with_views

PAIRS = [(a, b) for i, a in enumerate(DIMS) for b in DIMS[i + 1 :]]
RANKS = "rank_ AS (SELECT paper, page, role, " + ", ".join(f"rank() OVER (PARTITION BY role ORDER BY {d}) + (count(*) OVER (PARTITION BY role, {d}) - 1) / 2.0 AS {d}" for d in DIMS) + " FROM pages_)"
SPEAR = "spear_ AS (" + " UNION ALL ".join(f"SELECT role, '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS rho FROM rank_ GROUP BY role" for a, b in PAIRS) + ")"


@query("spearman_matrix", with_views(PAGES_SQL, RANKS, SPEAR, body="SELECT role, a, b, n, round(rho, 6) AS rho FROM spear_ WHERE n >= 50"))
def spearman_matrix(t: Tables) -> DataFrame:
    return statistics.spearman(t.pages, ["role"], DIMS, 50).select("role", "a", "b", "n", r6("rho").alias("rho"))


@query("redundancy_groups", with_views(PAGES_SQL, RANKS, SPEAR, "e_ AS (SELECT role, a, b FROM spear_ WHERE abs(rho) >= 0.8 UNION ALL SELECT role, b, a FROM spear_ WHERE abs(rho) >= 0.8)", body="SELECT role, grp, string_agg(m, ',' ORDER BY m) AS members FROM (SELECT role, a AS m, least(a, min(b)) AS grp FROM e_ GROUP BY role, a) GROUP BY role, grp"))
def redundancy_groups(t: Tables) -> DataFrame:
    """Connected groups of measures at an absolute rank correlation of 0.8 or more."""
    return statistics.groups(statistics.spearman(t.pages, ["role"], DIMS, 50), ["role"], 0.8)


@query("independent_dims", with_views(PAGES_SQL, RANKS, SPEAR, "e_ AS (SELECT role, a, b FROM spear_ WHERE abs(rho) >= 0.8 UNION ALL SELECT role, b, a FROM spear_ WHERE abs(rho) >= 0.8)", "d_ AS (SELECT role, unnest([" + ", ".join(f"'{d}'" for d in DIMS) + "]) AS dim FROM (SELECT DISTINCT role FROM pages_))", body="SELECT d_.role, d_.dim FROM d_ WHERE NOT EXISTS (SELECT 1 FROM e_ WHERE e_.role = d_.role AND e_.a = d_.dim AND e_.b < d_.dim)"))
def independent_dims(t: Tables) -> DataFrame:
    """One measure of each redundancy group, the first by name, and all measures outside of groups."""
    rho = statistics.spearman(t.pages, ["role"], DIMS, 50).where("abs(rho) >= 0.8")
    later = rho.select("role", F.greatest("a", "b").alias("dim")).distinct()
    dims = t.pages.select("role").distinct().select("role", F.explode(F.array(*map(F.lit, DIMS))).alias("dim"))
    return dims.join(later, ["role", "dim"], "left_anti")


Z = "z_ AS (SELECT paper, page, role, dim, greatest(-4, least(4, (value - center) / scale)) AS z FROM long_ JOIN block_ USING (role, dim))"


@query("corr_shrink", with_views(LONG_SQL, BLOCK, Z, """c_ AS (SELECT x.role, x.dim AS a, y.dim AS b, count(*) AS n, corr(x.z, y.z) AS r, var_samp(x.z * y.z) AS v FROM z_ x JOIN z_ y USING (role, paper, page) WHERE list_position(['quantity', 'price', 'discount', 'tax', 'unit_price', 'net_price'], x.dim) < list_position(['quantity', 'price', 'discount', 'tax', 'unit_price', 'net_price'], y.dim) GROUP BY 1, 2, 3),
d_ AS (SELECT role, greatest(0, least(1, sum(v) / max(n) / nullif(sum(r * r), 0))) AS delta FROM c_ GROUP BY role)""", body="SELECT role, a, b, n, round(r, 6) AS r, round(delta, 6) AS delta, round((1 - delta) * r, 6) AS shrunk FROM c_ JOIN d_ USING (role)"))
def corr_shrink(t: Tables) -> DataFrame:
    """Correlation of clipped z shrunk to the identity; all sums in one pass over wide z rows."""
    z = statistics.wide_z(t.written, profiles.wide_block(t.written, ["role"], DIMS), ["role"], DIMS)
    return statistics.shrunk_correlation(z, ["role"], DIMS).select("role", "a", "b", "n", *[r6(c).alias(c) for c in ("r", "delta", "shrunk")])


@query("complete_inverse")
def pattern_inverse(t: Tables) -> DataFrame:
    """Inverse of the shrunk correlation of each stratum, as rows and columns."""
    z = statistics.wide_z(t.written, profiles.wide_block(t.written, ["role"], DIMS), ["role"], DIMS)
    return statistics.inverses(statistics.shrunk_correlation(z, ["role"], DIMS), "role", DIMS).select("role", "i", "j", F.round("v", 5).alias("v"))


@query("complete_distance")
def mahalanobis_d2(t: Tables) -> DataFrame:
    """Squared distance of each page and its chi-square tail."""
    z = statistics.wide_z(t.written, profiles.wide_block(t.written, ["role"], DIMS), ["role"], DIMS)
    inverse = statistics.inverses(statistics.shrunk_correlation(z, ["role"], DIMS), "role", DIMS)
    return statistics.mahalanobis(z, inverse, "role", DIMS).select("paper", "page", F.round("d2", 4).alias("d2"), F.round("p", 6).alias("p"))


@query("pca_shares")
def pca_shares(t: Tables) -> DataFrame:
    """Explained shares of the principal components of the standardised measures."""
    return statistics.pca(t.pages, DIMS)


@query("dim_modes", with_views(LONG_SQL, body="SELECT role, dim, n, round(mode_n / n, 6) AS mode_share, round(p90 - p10, 6) AS width, mode_n / n < 0.5 AND p90 - p10 > 1e-9 AS valid FROM (SELECT role, dim, max(c) AS mode_n, sum(c) AS n FROM (SELECT role, dim, value, count(*) AS c FROM long_ GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN (SELECT role, dim, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM long_ GROUP BY 1, 2) USING (role, dim)").replace("SELECT role, dim, n, round", "SELECT role, dim, CAST(n AS BIGINT) AS n, round"))
def dim_modes(t: Tables) -> DataFrame:
    c = t.long.groupBy("role", "dim", "value").agg(F.count("*").alias("c"))
    width = wide_percentiles(t.pages, ["role"], DIMS, (0.1, 0.9)).select("role", "dim", (F.col("p")[1] - F.col("p")[0]).alias("w"))
    g = c.groupBy("role", "dim").agg(F.sum("c").alias("n"), F.max("c").alias("m")).join(width, ["role", "dim"])
    return g.select("role", "dim", "n", r6(F.col("m") / F.col("n")).alias("mode_share"), r6("w").alias("width"), ((F.col("m") / F.col("n") < 0.5) & (F.col("w") > 1e-9)).alias("valid"))


FOLD = "fold_ AS (SELECT s_suppkey AS paper, CAST(s_nationkey AS BIGINT) AS venue, CAST((row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_suppkey * 7919 + 17 * 104729) % 1000003, s_suppkey) - 1) % 5 AS BIGINT) AS fold FROM supplier)"


def folded(t: Tables) -> DataFrame:
    return evaluation.folds(t["supplier"].select(F.col("s_suppkey").alias("paper"), F.col("s_nationkey").cast("long").alias("venue")), "paper", "venue", 5)


def trained(parts: DataFrame) -> DataFrame:
    """Each row of a table by fold at the four test folds that train on it."""
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")), lambda k: k != F.col("fold"))
    return parts.withColumn("test_fold", F.explode(others)).drop("fold")


@query("fold_split", with_views(FOLD, body="SELECT paper, fold FROM fold_"))
def fold_split(t: Tables) -> DataFrame:
    return folded(t).select("paper", "fold")


@query("fold_profiles", with_views(LONG_SQL, FOLD, "k_ AS (SELECT unnest(range(5)) AS test_fold)", body="SELECT test_fold, role, dim, count(*) AS n, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75 FROM long_ JOIN fold_ USING (paper) JOIN k_ ON test_fold <> fold GROUP BY test_fold, role, dim"))
def fold_profiles(t: Tables) -> DataFrame:
    """Profiles of the training papers of every fold. Pages are counted by fold, and the counts are dealt to the training sets."""
    rows = cut(t.long.select("paper", "role", "dim", "value").join(F.broadcast(folded(t).select("paper", "fold")), "paper").select("fold", "role", "dim", "value"))
    keys = ["test_fold", "role", "dim"]
    p = percentiles(rows, keys, (0.25, 0.5, 0.75), parts=Parts(keys, ["fold", "role", "dim"], ["role", "dim"], trained))
    return p.select("test_fold", "role", "dim", "n", *[nearest6(F.col("p")[k]).alias(n) for k, n in enumerate(("p25", "p50", "p75"))])


@query("fp_single", with_views(PAGES_SQL, FOLD, "k_ AS (SELECT unnest(range(5)) AS test_fold)", "thr_ AS (SELECT test_fold, role, quantile_cont(net_price, 0.95) AS t95, quantile_cont(net_price, 0.97) AS t97 FROM pages_ JOIN fold_ USING (paper) JOIN k_ ON test_fold <> fold GROUP BY 1, 2)", body="SELECT p.role, count(*) AS n, round(avg(CASE WHEN net_price > t95 THEN 1.0 ELSE 0.0 END), 6) AS fp95, round(avg(CASE WHEN net_price > t97 THEN 1.0 ELSE 0.0 END), 6) AS fp97 FROM pages_ p JOIN fold_ f USING (paper) JOIN thr_ t ON t.test_fold = f.fold AND t.role = p.role GROUP BY p.role"))
def fp_protocol(t: Tables) -> DataFrame:
    """False-positive rates of training quantiles on held-out papers, pooled over the folds."""
    pages = t.pages.join(folded(t).select("paper", "fold"), "paper").select("fold", "role", F.col("net_price").alias("v"))
    c = cut(pages.groupBy("fold", "role", "v").agg(F.count("*").alias("c")))
    keys = ["test_fold", "role"]
    thr = percentiles(c, keys, (0.95, 0.97), "v", "c", Parts(keys, ["fold", "role"], ["role"], trained)).select("test_fold", "role", F.col("p")[0].alias("t95"), F.col("p")[1].alias("t97"))
    test = c.join(thr.withColumnRenamed("test_fold", "fold"), ["fold", "role"])
    rate = lambda q: r6(F.sum(F.when(F.col("v") > F.col(q), F.col("c")).otherwise(0)) / F.sum("c"))
    return test.groupBy("role").agg(F.sum("c").alias("n"), rate("t95").alias("fp95"), rate("t97").alias("fp97"))


@query("cluster_bootstrap_ci")
def cluster_bootstrap_ci(t: Tables) -> DataFrame:
    """Interval of the median by resampling papers: pages are weighted by how often their paper is drawn."""
    return statistics.bootstrap_median(t.long, "paper", ["role", "dim"], 300)


@query("paper_features", with_views(LONG_SQL, body="SELECT paper, dim, round(median, 6) AS median, round((median - quantile_cont(median, 0.5) OVER (PARTITION BY dim)) / CASE WHEN quantile_cont(median, 0.75) OVER (PARTITION BY dim) - quantile_cont(median, 0.25) OVER (PARTITION BY dim) < 1e-9 THEN 1.0 ELSE quantile_cont(median, 0.75) OVER (PARTITION BY dim) - quantile_cont(median, 0.25) OVER (PARTITION BY dim) END, 5) AS z FROM (SELECT paper, dim, quantile_cont(value, 0.5) AS median FROM long_ GROUP BY paper, dim HAVING count(*) >= 3)"))
def paper_features(t: Tables) -> DataFrame:
    m = cut(percentiles(t.long, ["paper", "dim"], (0.5,)).where("n >= 3").select("paper", "dim", F.col("p")[0].alias("median")))
    q = percentiles(m, ["dim"], (0.25, 0.5, 0.75), "median").select("dim", F.col("p").alias("q"))
    iqr = F.col("q")[2] - F.col("q")[0]
    return m.join(q, "dim").select("paper", "dim", r6("median").alias("median"), F.round((F.col("median") - F.col("q")[1]) / F.when(iqr < 1e-9, 1.0).otherwise(iqr), 5).alias("z"))


@query("separability_test")
def separability_test(t: Tables) -> DataFrame:
    """Leave-one-out accuracy of venues of 20 papers or more by nearest paper, and its permutation p value."""
    rows = t["lineitem"].join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_suppkey").alias("item"), (F.col("s_nationkey") % 5).cast("long").alias("label")).agg(F.avg("l_quantity").alias("x"), (F.avg("l_discount") * 100).alias("y"))
    return statistics.separability(rows, "item", "label", ["x", "y"], 100)


@query("stability_spread", with_views(LONG_SQL, body="SELECT dim, round(abs(b - a) / nullif(abs(a), 0), 6) AS drift, abs(b - a) / nullif(abs(a), 0) < 0.05 AS ok FROM (SELECT dim, avg(value) FILTER (WHERE page % 2 = 0) AS a, avg(value) FILTER (WHERE page % 2 = 1) AS b FROM long_ GROUP BY dim HAVING count(*) >= 3)"))
def stability_spread(t: Tables) -> DataFrame:
    half = lambda k: F.avg(F.when(F.col("page") % 2 == k, F.col("value")))
    g = t.long.groupBy("dim").agg(half(0).alias("a"), half(1).alias("b"), F.count("*").alias("n")).where("n >= 3")
    d = F.try_divide(F.abs(F.col("b") - F.col("a")), F.abs("a"))
    return g.select("dim", r6(d).alias("drift"), (d < 0.05).alias("ok"))


@query("determinism_check", with_views(LONG_SQL, body="SELECT 0::BIGINT AS differing"))
def determinism_check(t: Tables) -> DataFrame:
    """Rows in which two evaluations of one profile differ."""
    one = profiles.wide_block(t.pages, ["role"], DIMS).select("role", "dim", "center", "scale")
    dealt = cut(t.pages.repartition("page").select("role", *DIMS))  # page rows, dealt once
    two = profiles.robust_block(to_long(dealt, ["role"], DIMS), ["role"]).select("role", "dim", "center", "scale")
    return one.exceptAll(two).unionAll(two.exceptAll(one)).agg(F.count("*").alias("differing"))


GATE = """g_ AS (SELECT dim, count(*) AS n, round(avg(CASE WHEN abs(value) < 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS zero, stddev_pop(value) / avg(value) AS cv FROM long_ GROUP BY dim)"""


@query("dim_gate", with_views(LONG_SQL, GATE, body="SELECT dim, CASE WHEN zero > 0.05 OR cv < 0.5 THEN 'report' ELSE 'pass' END AS gate, array_to_string(list_filter([CASE WHEN zero > 0.05 THEN 'zeros' END, CASE WHEN cv < 0.5 THEN 'narrow' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g_"))
def dim_gate(t: Tables) -> DataFrame:
    g = t.long.groupBy("dim").agg(r6(F.avg(F.when(F.abs("value") < 1e-9, 1.0).otherwise(0.0))).alias("zero"), (F.stddev_pop("value") / F.avg("value")).alias("cv"))
    why = F.array_compact(F.array(F.when(F.col("zero") > 0.05, "zeros"), F.when(F.col("cv") < 0.5, "narrow")))
    return g.select("dim", F.when(F.size(why) > 0, "report").otherwise("pass").alias("gate"), F.array_join(why, ",").alias("reasons"))


@query("block_filter", with_views(LONG_SQL, BLOCK, GATE, WEIGHT_SQL, body="SELECT role, dim, round(center, 6) AS center, coalesce(w, 1.0)::DOUBLE AS weight FROM block_ JOIN (SELECT dim FROM g_ WHERE NOT (zero > 0.05 OR cv < 0.5)) USING (dim) LEFT JOIN w_ USING (dim)"))
def block_filter(t: Tables) -> DataFrame:
    """Blocks without the gated dims, with weights."""
    gated = dim_gate(t).where("gate = 'report'").select("dim")
    weights = t.spark.createDataFrame(list(WEIGHTS.items()), "dim string, w double")
    block = profiles.wide_block(t.pages, ["role"], DIMS).join(gated, "dim", "left_anti").join(weights, "dim", "left")
    return block.select("role", "dim", r6("center").alias("center"), F.coalesce("w", F.lit(1.0)).alias("weight"))


LADDER = "ladder_ AS (SELECT role, dim, k, sg, greatest(0, center + sg * scale * CASE k WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 WHEN 3 THEN 2.0 ELSE 4.0 END) AS v, lo, hi, scale FROM block_, (SELECT unnest([1, 2, 3, 4]) AS k), (SELECT unnest([1, -1]) AS sg))"


@query("degradation_ladder", with_views(LONG_SQL, BLOCK, LADDER, body="SELECT role, dim, CAST(k AS BIGINT) AS k, CAST(sg AS BIGINT) AS sign, round(v, 6) AS v FROM ladder_"))
def degradation_ladder(t: Tables) -> DataFrame:
    return statistics.ladder(profiles.wide_block(t.pages, ["role"], DIMS)).select("role", "dim", "k", "sign", r6("v").alias("v"))


@query("degradation_direction", with_views(LONG_SQL, BLOCK, LADDER, body="""SELECT role, dim, CAST(max_by(sg, (mono, rise, sg)) AS BIGINT) AS sign, max_by(mono, (mono, rise, sg)) = 1 AS monotone FROM (SELECT role, dim, sg, CASE WHEN min(d) >= -1e-9 THEN 1 ELSE 0 END AS mono, round(max(loss) - min(loss), 6) AS rise FROM (
 SELECT *, loss - lag(loss) OVER (PARTITION BY role, dim, sg ORDER BY k) AS d FROM (SELECT *, CASE WHEN v > hi THEN (v - hi) / scale WHEN v < lo THEN 1.2 * (lo - v) / scale ELSE 0.0 END AS loss FROM ladder_)) GROUP BY role, dim, sg) GROUP BY role, dim"""))
def degradation_direction(t: Tables) -> DataFrame:
    """The sign whose ladder raises the loss steadily, and more."""
    return statistics.direction(statistics.ladder(profiles.wide_block(t.pages, ["role"], DIMS)))


@query("bradley_terry_logit")
def bradley_terry_logit(t: Tables) -> DataFrame:
    """Preference weights from pairs of documents, the better one by its label."""
    return statistics.preference_weights(preference_pairs(t), ["a_len", "a_lines", "a_marks"])


def preference_pairs(t: Tables) -> DataFrame:
    x = F.col("text")
    m = t["documents"].join(t["labels"].select("doc_id", "quality"), "doc_id").select("doc_id", "quality", F.log1p(F.length(x)).alias("len"), F.size(F.split(x, "\n", -1)).alias("lines"), (F.regexp_count(x, F.lit("[#$%&*|!]")) / (F.length(x) + 1)).alias("marks"))
    g = m.withColumn("slot", F.col("doc_id") % 50)
    good, bad = g.where("quality = 1").alias("p"), g.where("quality = 0").alias("q")
    j = good.join(bad, F.col("p.slot") == F.col("q.slot"))
    return j.select(*[(F.col(f"p.{c}") - F.col(f"q.{c}")).alias(f"a_{c}") for c in ("len", "lines", "marks")])


@query("bradley_terry_mm")
def bradley_terry_mm(t: Tables) -> DataFrame:
    """Strengths of venues from wins between their papers."""
    return statistics.strengths(wins(t), "a", "b", "wins_a", "wins_b")


def wins(t: Tables) -> DataFrame:
    o = t["orders"].select(F.col("o_orderpriority").alias("x"), F.lead("o_orderpriority").over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("y"), (F.col("o_totalprice") > 250_000).alias("first")).where("y is not null and x <> y")
    a = F.least("x", "y")
    won = F.when(F.col("first") == (F.col("x") == a), 1.0).otherwise(0.0)
    return o.select(a.alias("a"), F.greatest("x", "y").alias("b"), won.alias("w")).groupBy("a", "b").agg(F.sum("w").alias("wins_a"), F.sum(1 - F.col("w")).alias("wins_b"))


@query("win_tally", """SELECT least(x, y) AS a, greatest(x, y) AS b, sum(CASE WHEN f = (x = least(x, y)) THEN 1.0 ELSE 0.0 END)::DOUBLE AS wins_a, sum(CASE WHEN f = (x = least(x, y)) THEN 0.0 ELSE 1.0 END)::DOUBLE AS wins_b FROM (
 SELECT o_orderpriority AS x, lead(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS y, o_totalprice > 250000 AS f FROM orders) WHERE y IS NOT NULL AND x <> y GROUP BY 1, 2""")
def win_tally(t: Tables) -> DataFrame:
    return wins(t)


@query("answers_to_preference", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 0.5 WHEN (event_type = 'click') = (event_id % 2 = 0) THEN 1.0 ELSE 0.0 END::DOUBLE AS b FROM events")
def answers_to_preference(t: Tables) -> DataFrame:
    left = F.col("event_id") % 2 == 0
    b = F.when(F.col("event_type") == "view", 0.5).when((F.col("event_type") == "click") == left, 1.0).otherwise(0.0)
    return t["events"].select("event_id", F.when(F.col("event_type") != "error", b).alias("b"))


@query("answers_to_pairs", "SELECT event_id AS q, CASE WHEN (event_type = 'click') = (user_id % 2 = 0) THEN 'a' ELSE 'b' END AS winner FROM events WHERE event_type IN ('click', 'view')")
def answers_to_pairs(t: Tables) -> DataFrame:
    return t["events"].where(F.col("event_type").isin("click", "view")).select(F.col("event_id").alias("q"), F.when((F.col("event_type") == "click") == (F.col("user_id") % 2 == 0), "a").otherwise("b").alias("winner"))


@query("pair_summary", with_views(LONG_SQL, body="SELECT dim, count(*) AS n, list_sort(list(d))[CAST(floor(count(*) / 2.0) AS BIGINT) + 1] AS median_abs FROM (SELECT dim, abs(value - lead(value) OVER (PARTITION BY paper, dim ORDER BY page)) AS d FROM long_ WHERE dim IN ('quantity', 'tax')) WHERE d IS NOT NULL GROUP BY dim"))
def pair_summary(t: Tables) -> DataFrame:
    from foliometry.operators.aggregates import ranks_of, upper_median_rank

    d = F.abs(F.col("value") - F.lead("value").over(W.partitionBy("paper", "dim").orderBy("page")))
    return ranks_of(t.long.where("dim in ('quantity', 'tax')").select("dim", d.alias("d")), ["dim"], {"median_abs": upper_median_rank()}, "d").select("dim", "n", "median_abs")


@query("indifference_point", "SELECT k, round(CASE WHEN lo IS NOT NULL AND hi IS NOT NULL AND hi >= lo THEN (lo + hi) / 2 WHEN lo IS NOT NULL THEN lo ELSE hi END, 6) AS point, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL AND hi >= lo THEN 'mid' WHEN lo IS NOT NULL THEN 'lower' ELSE 'upper' END AS kind FROM (SELECT p_brand AS k, max(p_size) FILTER (WHERE p_retailprice % 3 < 1.5) AS lo, min(p_size) FILTER (WHERE p_retailprice % 3 >= 2.9) AS hi FROM part GROUP BY 1)")
def indifference_point(t: Tables) -> DataFrame:
    """Between the largest cost still preferred and the smallest one refused; a bound where one side is missing."""
    m = F.col("p_retailprice") % 3
    g = t["part"].groupBy(F.col("p_brand").alias("k")).agg(F.max(F.when(m < 1.5, F.col("p_size"))).alias("lo"), F.min(F.when(m >= 2.9, F.col("p_size"))).alias("hi"))
    both = F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("hi") >= F.col("lo"))
    point = F.when(both, (F.col("lo") + F.col("hi")) / 2).when(F.col("lo").isNotNull(), F.col("lo")).otherwise(F.col("hi"))
    return g.select("k", r6(point.cast("double")).alias("point"), F.when(both, "mid").when(F.col("lo").isNotNull(), "lower").otherwise("upper").alias("kind"))


VARIANT = "var_ AS (SELECT dim, role, avg(value) AS m FROM long_ GROUP BY dim, role)"


@query("variant_range", with_views(LONG_SQL, VARIANT, body="SELECT dim, round(max(m) - min(m), 6) AS span, count(DISTINCT round(m, 6)) AS n_distinct, max(m) - min(m) >= 0.1 AS responds FROM var_ GROUP BY dim"))
def variant_range(t: Tables) -> DataFrame:
    g = t.long.groupBy("dim", "role").agg(F.avg("value").alias("m")).groupBy("dim")
    span = F.max("m") - F.min("m")
    return g.agg(r6(span).alias("span"), F.count_distinct(F.round("m", 6)).alias("n_distinct"), (span >= 0.1).alias("responds"))


@query("response_weights", with_views(LONG_SQL, VARIANT, body="SELECT dim, round(6.0 * sqrt(resp) / sum(sqrt(resp)) OVER (), 6) AS weight FROM (SELECT dim, greatest(max(m) - max(m) FILTER (WHERE role = 'A'), 1e-6) AS resp FROM var_ GROUP BY dim)"))
def response_weights(t: Tables) -> DataFrame:
    """Weights by the square root of the response over the baseline variant, with a fixed total."""
    g = t.long.groupBy("dim", "role").agg(F.avg("value").alias("m")).groupBy("dim").agg(F.greatest(F.max("m") - F.max(F.when(F.col("role") == "A", F.col("m"))), F.lit(1e-6)).alias("resp"))
    return g.select("dim", r6(6.0 * F.sqrt("resp") / F.sum(F.sqrt("resp")).over(W.partitionBy())).alias("weight"))


@query("sensitivity_table", with_views(LONG_SQL, body="SELECT dim, count(*) FILTER (WHERE d > 0.1 * abs(base)) AS responding, count(*) AS docs, round(quantile_cont(d, 0.5), 6) AS median_delta FROM (SELECT paper, dim, avg(value) FILTER (WHERE layout = 'F') AS base, max(value) - avg(value) FILTER (WHERE layout = 'F') AS d FROM long_ GROUP BY paper, dim) GROUP BY dim"))
def sensitivity_table(t: Tables) -> DataFrame:
    base = F.avg(F.when(F.col("layout") == "F", F.col("value")))
    g = cut(t.long.groupBy("paper", "dim").agg(base.alias("base"), (F.max("value") - base).alias("d")))
    median = percentiles(g, ["dim"], (0.5,), "d").select("dim", r6(F.col("p")[0]).alias("median_delta"))
    return joined(g.groupBy("dim").agg(F.count_if(F.col("d") > 0.1 * F.abs("base")).alias("responding"), F.count("*").alias("docs")), median, ["dim"], "left")


@query("identifiability", with_views(LONG_SQL, body="SELECT dim, round(avg(within_sd), 6) AS within_sd, round(stddev_pop(mean), 6) AS between_sd, CASE WHEN max(within_sd) < 1e-9 THEN 'drop' WHEN stddev_pop(mean) < 0.05 * avg(within_sd) THEN 'stratify' ELSE 'keep' END AS verdict FROM (SELECT paper, dim, avg(value) AS mean, stddev_pop(value) AS within_sd FROM long_ GROUP BY 1, 2) GROUP BY dim"))
def identifiability(t: Tables) -> DataFrame:
    """Spread within and between documents, and what to do with the measure."""
    g = t.long.groupBy("paper", "dim").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("w")).groupBy("dim")
    verdict = F.when(F.max("w") < 1e-9, "drop").when(F.stddev_pop("mean") < 0.05 * F.avg("w"), "stratify").otherwise("keep")
    return g.agg(r6(F.avg("w")).alias("within_sd"), r6(F.stddev_pop("mean")).alias("between_sd"), verdict.alias("verdict"))


@query("level_attribution", with_views(LONG_SQL, body="SELECT role, round(avg(value) FILTER (WHERE dim = 'quantity'), 6) AS quantity, round(avg(value) FILTER (WHERE dim = 'tax'), 6) AS tax, round(avg(value) FILTER (WHERE dim = 'discount'), 6) AS discount FROM long_ GROUP BY role"))
def level_attribution(t: Tables) -> DataFrame:
    return t.long.groupBy("role").pivot("dim", ["quantity", "tax", "discount"]).agg(r6(F.avg("value")))


@query("detector_verdict", with_views(LONG_SQL, body="SELECT dim, CASE WHEN zero > 0.5 THEN 'hold' WHEN cv < 0.2 THEN 'change' ELSE 'usable' END AS verdict FROM (SELECT dim, avg(CASE WHEN abs(value) < 1e-9 THEN 1.0 ELSE 0.0 END) AS zero, stddev_pop(value) / avg(value) AS cv FROM long_ GROUP BY dim)"))
def detector_verdict(t: Tables) -> DataFrame:
    zero, cv = F.avg(F.when(F.abs("value") < 1e-9, 1.0).otherwise(0.0)), F.stddev_pop("value") / F.avg("value")
    return t.long.groupBy("dim").agg(F.when(zero > 0.5, "hold").when(cv < 0.2, "change").otherwise("usable").alias("verdict"))


@query("pair_agreement", """WITH j AS (SELECT l.quality, CASE WHEN regexp_matches(text, '[#$%&*|!]') THEN 0 ELSE 1 END AS model FROM documents JOIN labels l USING (doc_id)) SELECT count(*) AS n, count(*) FILTER (WHERE quality = model) AS hits, round(avg(CASE WHEN quality = model THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
(SELECT round(sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))), 6) FROM (SELECT n, unnest(range(hits, n + 1)) AS k FROM (SELECT count(*) AS n, count(*) FILTER (WHERE quality = model) AS hits FROM j))) AS tail FROM j""")
def pair_agreement(t: Tables) -> DataFrame:
    """Agreement of a model's choice with human choice, and the exact one-sided tail of that many hits by chance."""
    model = F.when(F.col("text").rlike("[#$%&*|!]"), 0).otherwise(1)
    j = t["documents"].join(t["labels"], "doc_id").select((F.col("quality") == model).alias("hit"))
    g = j.agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), r6(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0))).alias("accuracy"))
    return g.withColumn("tail", r6(statistics.binomial_tail(F.col("n"), F.col("hits"))))


@query("human_rank_corr", """SELECT lang, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY lang ORDER BY quality) + (count(*) OVER (PARTITION BY lang, quality) - 1) / 2.0 AS ry FROM documents JOIN labels USING (doc_id)) GROUP BY lang HAVING count(*) >= 8""")
def human_rank_corr(t: Tables) -> DataFrame:
    j = t["documents"].select("doc_id", "lang", "n_chars").join(t["labels"].select("doc_id", "quality"), "doc_id")
    r = ranked(ranked(cut(j), ["lang"], "n_chars", "rx"), ["lang"], "quality", "ry")
    return r.groupBy("lang").agg(F.count("*").alias("n"), r6(corr("rx", "ry")).alias("rho")).where("n >= 8")


@query("noise_weights", with_views(LONG_SQL, BLOCK, LOSS, NORM, body="""SELECT dim, round(greatest(0.25, least(4.0, c / avg(c) OVER ())), 6) AS weight FROM (SELECT dim, greatest(0.25, least(4.0, (quantile_cont(norm, 0.95) - quantile_cont(norm, 0.5)) / (quantile_cont(norm, 0.9) + 0.05))) AS c FROM norm_ GROUP BY dim)"""))
def signal_noise_weights(t: Tables) -> DataFrame:
    """Signal over noise of each dim's loss, clipped, brought to mean 1, clipped again."""
    norm = profiles.normalise(profiles.page_losses(t.kept, profiles.robust_block(t.kept, ["role"]), ["role"]), ["role"])
    p = percentiles(norm, ["dim"], (0.5, 0.9, 0.95), "norm")
    clip = lambda c: F.greatest(F.lit(0.25), F.least(F.lit(4.0), c))
    g = p.select("dim", clip((F.col("p")[2] - F.col("p")[0]) / (F.col("p")[1] + 0.05)).alias("c"))
    return g.select("dim", r6(clip(F.col("c") / F.avg("c").over(W.partitionBy()))).alias("weight"))


@query("margin_stats", with_views(LONG_SQL, BLOCK, LOSS, NORM, TOP.replace("top_ AS", "pool_ AS").replace("FROM long_", "FROM norm_").replace("value", "norm"), WEIGHT_SQL, body="""SELECT round(quantile_cont(new - old, 0.5), 5) AS median_margin, round(avg(CASE WHEN new > old THEN 1.0 ELSE 0.0 END), 6) AS positive, count(*) AS n FROM (SELECT paper, sum(w * (0.5 * top_mean + 0.5 * mean)) / sum(w) AS new, avg(0.5 * top_mean + 0.5 * mean) AS old FROM pool_ JOIN w_ USING (dim) GROUP BY paper)"""))
def margin_stats(t: Tables) -> DataFrame:
    """Margins of the scores under new weights over those under equal weights."""
    losses = profiles.normalise(profiles.page_losses(t.kept, profiles.robust_block(t.kept, ["role"]), ["role"]), ["role"])
    pooled = profiles.pooled(losses, ["paper", "dim"], "norm")
    both = profiles.weighted_score(pooled, ["paper"], "pooled", WEIGHTS).select("paper", F.col("score").alias("new")).join(profiles.weighted_score(pooled, ["paper"], "pooled", {}).select("paper", F.col("score").alias("old")), "paper")
    d = F.col("d")
    rows = cut(both.select(F.lit("all").alias("of"), (F.col("new") - F.col("old")).alias("d")))
    counts = rows.groupBy("of").agg(r6(F.avg(F.when(d > 0, 1.0).otherwise(0.0))).alias("positive"), F.count("*").alias("n"))
    return joined(counts, percentiles(rows, ["of"], (0.5,), "d").drop("n"), ["of"]).select(F.round(F.col("p")[0], 5).alias("median_margin"), "positive", "n")


@query("document_scores", with_views(LONG_SQL, BLOCK, LOSS, NORM, TOP.replace("top_ AS", "pool_ AS").replace("FROM long_", "FROM norm_").replace("value", "norm"), WEIGHT_SQL, "score_ AS (SELECT paper, sum(w * (0.5 * top_mean + 0.5 * mean)) / sum(w) AS score FROM pool_ JOIN w_ USING (dim) GROUP BY paper)", "odd_ AS (SELECT paper, count(*) FILTER (WHERE round(s, 6) > 12) AS anomalous, arg_max(page, (round(s, 6), -page)) AS worst_page FROM (SELECT paper, page, sum(norm) AS s FROM norm_ GROUP BY 1, 2) GROUP BY paper)", body="SELECT paper, round(score, 5) AS score, anomalous, worst_page FROM score_ JOIN odd_ USING (paper)"))
def evaluate_docs(t: Tables) -> DataFrame:
    """Documents against the profile: weighted score, anomalous pages and the worst page, all documents in one job."""
    norm = profiles.wide_norms(t.written, t.kept, ["paper", "page"], ["role"], DIMS)
    s = r6(sum((F.coalesce(d, F.lit(0.0)) for d in DIMS[1:]), F.coalesce(DIMS[0], F.lit(0.0))))
    lists, value = profiles.pooled_lists(DIMS)
    odd = [F.count_if(F.col("s") > 12).alias("anomalous"), F.max_by("page", F.struct("s", (-F.col("page")).alias("p"))).alias("worst_page")]
    rows = norm.dropna("all", subset=DIMS).withColumn("s", s).groupBy("paper").agg(*lists, *odd).select("paper", "anomalous", "worst_page", *[c.alias(d) for d, c in value.items()])
    there = lambda f: sum((F.when(F.col(d).isNotNull(), f(d)).otherwise(0.0) for d in DIMS[1:]), F.when(F.col(DIMS[0]).isNotNull(), f(DIMS[0])).otherwise(0.0))
    score = there(lambda d: WEIGHTS[d] * F.col(d)) / there(lambda d: F.lit(WEIGHTS[d]))
    return rows.select("paper", F.round(score, 5).alias("score"), "anomalous", "worst_page")
