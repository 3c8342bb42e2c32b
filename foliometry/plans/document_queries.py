"""Queries of document scores and trials on the stand-in pages, whose discount and tax of 0 count as missing, and of file sources.

Matrix inverses and resampling are beyond SQL; tests compare these operators with plain numpy (tests/test_documents.py).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliometry.functions.scalar import nearest6, r6
from foliometry.operators import documents, profiles
from foliometry.operators.lineage import cut, folder
from foliometry.plans.profile_queries import BLOCK, LOSS, WEIGHTS
from foliometry.plans.registry import DIMS, LONG_SQL, PAGES_SQL, SQL, Tables, query, with_views
from foliometry.plans.stat_queries import folded
from foliometry.sources import scans
from foliometry.streaming.incremental import score_arrivals

#: Papers of a usable stratum: fewer than in a real corpus, as the smallest stand-in has ten papers.
LEAST = 6
UNIT, NON_NEGATIVE = ("discount", "tax"), ("quantity", "price", "unit_price", "net_price")


def pages(t: Tables) -> DataFrame:
    return cut(t.pages.withColumn("discount", F.nullif("discount", F.lit(0.0))).withColumn("tax", F.nullif("tax", F.lit(0.0))))


def scored(t: Tables, tails: bool = True) -> tuple[documents.Profile, DataFrame]:
    """The profile of all pages and their scores, without the chi-square tail where it is not read."""
    rows = pages(t)
    profile = documents.fit(rows, DIMS, LEAST, WEIGHTS)
    return profile, cut(documents.page_scores(rows, profile, tails))


@query("pattern_inverse")
def pattern_inverses(t: Tables) -> DataFrame:
    """Inverse of the shrunk correlation for each stratum and pattern of measures that are there."""
    return documents.fit(pages(t), DIMS, LEAST).inverses.select("stratum", "pattern", F.posexplode("inverse").alias("cell", "v")).where("v <> 0")


@query("mahalanobis_d2")
def page_distances(t: Tables) -> DataFrame:
    """Each page's stratum, distance over the measures that it has, and the chi-square tail."""
    return scored(t)[1].select("paper", "page", "stratum", F.round("d2", 4).alias("d2"), F.col("k").cast("long").alias("k"), F.round("p", 6).alias("p"))


@query("evaluate_docs")
def document_reports(t: Tables) -> DataFrame:
    """Documents against the profile: score, scored and anomalous pages, the most distant page, strata used."""
    profile, scores = scored(t)
    return documents.reports(scores, profile).select("paper", F.round("a_profile", 5).alias("a_profile"), "n_pages", "n_scored", "n_anomalous", "top_page", "levels_used")


@query("injection_trials")
def injection_trials(t: Tables) -> DataFrame:
    """One page of each paper degraded measure by measure: does the document's score rise, and is the page found."""
    profile, scores = scored(t, tails=False)
    return documents.injection_trials(scores, profile, UNIT, NON_NEGATIVE).select("paper", "page", "dim", "sign", "monotone", "strict", F.round("delta", 5).alias("delta"), "rank", "localized")


@query("ablation_trials")
def ablation_trials(t: Tables) -> DataFrame:
    """One page of each paper with each of its measures changed: what the paper's pooled losses were, and by how much they rise."""
    profile, scores = scored(t, tails=False)
    return documents.ablation_trials(scores, profile, UNIT, NON_NEGATIVE).select("paper", "page", "dim", "sign", "alpha", "measure", r6("before").alias("before"), r6("delta").alias("delta"))


@query("signal_noise_weights")
def trial_weights(t: Tables) -> DataFrame:
    """Weights from trials: signal of the changed measure over the noise of the others."""
    profile, scores = scored(t, tails=False)
    trials = cut(documents.ablation_trials(scores, profile, UNIT, NON_NEGATIVE))
    return documents.trial_weights(trials, DIMS).select("dim", r6("signal").alias("signal"), r6("noise").alias("noise"), "weight")


@query("weights_bootstrap")
def weights_bootstrap(t: Tables) -> DataFrame:
    """Interval of each weight over resampled papers."""
    profile, scores = scored(t, tails=False)
    trials = cut(documents.ablation_trials(scores, profile, UNIT, NON_NEGATIVE))
    return documents.weights_bootstrap(trials, DIMS)


@query("fp_protocol")
def fp_rules(t: Tables) -> DataFrame:
    """False positives on held-out papers, pooled over five folds, by role (null: all): chi-square tail, and P95, P96, P97 of training pages."""
    rows = cut(pages(t).join(folded(t).select("paper", "fold"), "paper"))
    return documents.false_positives(rows, DIMS, "fold", 5, LEAST).select("role", "n", *[r6(c).alias(c) for c in ("chi2", "p95", "p96", "p97")], "top_dim")


PAGE_DOC = "paper long, venue long, pages array<struct<page:long,role:string,quantity:double,discount:double>>"


@query("scan_page_docs", with_views(PAGES_SQL, body="SELECT paper, venue, page, role, quantity, discount FROM pages_"))
def scan_page_docs(t: Tables) -> DataFrame:
    """Documents written as JSON, one a line and a damaged one among them, read back as page rows."""
    path = f"{folder(t.spark)}/page-docs-{uuid.uuid4().hex}"
    docs = t.pages.groupBy("paper", "venue").agg(F.collect_list(F.struct("page", "role", "quantity", "discount")).alias("pages"))
    docs.select(F.to_json(F.struct("paper", "venue", "pages")).alias("value")).write.text(path)
    t["region"].select(F.concat(F.lit('{"paper": '), "r_name").alias("value")).write.mode("append").text(path)
    return scans.page_docs(t.spark, path, t.spark.createDataFrame([], PAGE_DOC).schema, multi_line=False)[0].select("paper", "venue", "page.page", "page.role", "page.quantity", "page.discount")


@query("sink_profile", SQL["profile_levels"])
def sink_profile(t: Tables) -> DataFrame:
    """The profile written as a table by level, replaced as a whole, and read back."""
    path = f"{folder(t.spark)}/profile-{uuid.uuid4().hex}"
    profile = cut(profiles.profile_levels(t.long))
    for _ in range(2):
        scans.write_profile(profile, path)
    return t.spark.read.parquet(path)


@query("incremental_scoring", with_views(LONG_SQL, BLOCK, LOSS, body="SELECT paper, page, dim, round(loss, 6) AS loss FROM loss_"))
def incremental_scoring(t: Tables) -> DataFrame:
    """Page rows that arrive in two lots, scored against a frozen profile."""
    path = f"{folder(t.spark)}/arrivals-{uuid.uuid4().hex}"
    block = cut(profiles.robust_block(t.kept, ["role"]))
    rows = t.kept.select("paper", "page", "dim", "role", "value")
    for lot in (0, 1):
        rows.where(F.col("paper") % 2 == lot).write.mode("append").parquet(f"{path}/in")
        score_arrivals(t.spark, f"{path}/in", rows.schema, block, f"{path}/out", f"{path}/state").awaitTermination()
    return t.spark.read.parquet(f"{path}/out").select("paper", "page", "dim", nearest6("loss").alias("loss"))
