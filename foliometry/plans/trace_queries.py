"""Queries of traces of versions: stand-ins made from orders, one document for each customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliometry.operators import traces
from foliometry.plans.registry import Tables, query, with_views

MOST_PAGES, MOST_M2 = 8, 6.0
TRACE = f"""
tv_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY version) AS seq FROM (SELECT o_custkey AS doc, o_orderkey AS version, o_orderkey % 3 + CASE WHEN pages > {MOST_PAGES} THEN 1 ELSE 0 END AS n_gate, coalesce(pages > {MOST_PAGES}, FALSE) AS long, pages,
  o_orderkey % 17 <> 3 AS scored, m1, CAST(o_orderkey % 9 AS DOUBLE) AS m2, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS defects
 FROM (SELECT *, CASE WHEN o_orderkey % 29 = 7 THEN NULL ELSE 5 + o_orderkey % 7 END AS pages, CASE WHEN o_orderkey % 23 = 5 THEN NULL ELSE CAST(floor(o_totalprice / 60000) AS DOUBLE) END AS m1 FROM orders))),
fold_ AS (
 SELECT doc, seq, version, CAST(NULL AS BIGINT) AS base, TRUE AS accepted, 'first' AS reason, version AS hv, n_gate AS hg, long AS hl, pages AS hp, m1 AS h1, m2 AS h2 FROM tv_ WHERE seq = 1
 UNION ALL
 SELECT doc, seq, version, hv, accepted, reason, CASE WHEN accepted THEN version ELSE hv END, CASE WHEN accepted THEN n_gate ELSE hg END, CASE WHEN accepted THEN long ELSE hl END, CASE WHEN accepted THEN pages ELSE hp END, CASE WHEN accepted THEN m1 ELSE h1 END, CASE WHEN accepted THEN m2 ELSE h2 END
 FROM (SELECT *, reason IN ('fewer broken rules', 'compression, no more pages', 'lower m1', 'lower m2') AS accepted FROM (SELECT v.*, f.hv, f.hg, f.hl, f.hp, f.h1, f.h2, CASE
   WHEN v.n_gate <> f.hg THEN CASE WHEN v.n_gate < f.hg THEN 'fewer broken rules' ELSE 'more broken rules' END
   WHEN v.long AND f.hl THEN CASE WHEN v.pages <= coalesce(f.hp, 999999) THEN 'compression, no more pages' ELSE 'compression, more pages' END
   WHEN v.n_gate > 0 OR NOT v.scored THEN 'not scored' WHEN v.m1 IS NULL OR f.h1 IS NULL THEN 'm1 missing' WHEN v.m1 < f.h1 THEN 'lower m1' WHEN v.m1 > f.h1 THEN 'higher m1' WHEN v.m2 < f.h2 THEN 'lower m2' ELSE 'no gain' END AS reason
   FROM fold_ f JOIN tv_ v ON v.doc = f.doc AND v.seq = f.seq + 1)))"""


def trace(t: Tables) -> DataFrame:
    """Versions in order: doc, seq, version, n_gate, long, pages, scored, m1, m2, defects (the view tv_ of the SQL)."""
    k = F.col("o_orderkey")
    rows = t["orders"].select(
        F.col("o_custkey").alias("doc"), k.alias("seq"), k.alias("version"), F.when(k % 29 != 7, 5 + k % 7).alias("pages"), (k % 17 != 3).alias("scored"), F.when(k % 23 != 5, F.floor(F.col("o_totalprice") / 60000).cast("double")).alias("m1"),
        (k % 9).cast("double").alias("m2"), F.when(k % 5 == 0, 1).otherwise(0).alias("defects"), (k % 3).alias("other"),
    )
    long = F.coalesce(F.col("pages") > MOST_PAGES, F.lit(False))
    return rows.withColumn("long", long).withColumn("n_gate", F.col("other") + F.col("long").cast("int")).drop("other")


@query("lexi_accept", with_views("RECURSIVE " + TRACE.strip(), body="SELECT doc, version, base, accepted, reason FROM fold_"))
def lexi_accept(t: Tables) -> DataFrame:
    """Each version against the last accepted one: broken rules, pages while both are too long, then m1, then m2."""
    return traces.judged(trace(t)).drop("seq")


@query("run_status", with_views("RECURSIVE " + TRACE.strip(), f"""end_ AS (SELECT doc, count(*) - 1 AS attempts, count_if(accepted) - 1 AS accepted, max(version) FILTER (WHERE accepted) AS version FROM fold_ GROUP BY doc)""", body=f"""SELECT e.doc, CASE WHEN n_gate > 0 THEN CASE WHEN attempts > 0 THEN 'EXHAUSTED' ELSE 'BLOCKED_GATE' END
 WHEN defects > 0 OR m2 > {MOST_M2} THEN 'NEEDS_REVIEW' WHEN attempts = 0 THEN 'CONVERGED' WHEN accepted = 0 THEN 'NO_IMPROVEMENT' ELSE 'DONE' END AS status, attempts, accepted, e.version FROM end_ e JOIN tv_ v ON v.doc = e.doc AND v.version = e.version"""))
def run_status(t: Tables) -> DataFrame:
    """How each document's run ends, by its last accepted version."""
    return traces.final_status(trace(t), MOST_M2)
