"""Queries of sources: manifests, latest records, indexes, traces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliometry.operators.lineage import folder
from foliometry.plans.registry import Tables, query
from foliometry.sources import nested, scans


@query("scan_docs_by_id", "SELECT conv_id, count(*) AS n_turns FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY conv_id HAVING count(*) > 0")
def scan_docs_by_id(t: Tables) -> DataFrame:
    docs = t["conversations"].groupBy("conv_id").agg(F.collect_list("turn").alias("pages"))
    ids = t["labels"].where("quality = 1").select(F.col("doc_id").alias("conv_id"))
    return scans.docs_by_id(docs, ids, "conv_id", "pages").select("conv_id", F.size("pages").cast("long").alias("n_turns"))


@query("props_json", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def props_json(t: Tables) -> DataFrame:
    """Line JSON of a text column."""
    return t["events"].select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", "p.k")


@query("scan_manifest_ok", "SELECT o_orderkey AS case_id, m.value FROM orders LEFT JOIN (SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1) m ON m.user_id = o_orderkey WHERE o_orderstatus = 'F'")
def scan_manifest_ok(t: Tables) -> DataFrame:
    manifest = t["orders"].select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status"))
    meta = t["events"].select(F.col("user_id").alias("case_id"), "event_id", "value")
    return scans.manifest_ok(manifest, meta, "case_id", "status", "event_id").select("case_id", "value")


@query("fetch_log_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def fetch_log_latest(t: Tables) -> DataFrame:
    return scans.latest(t["events"].select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("append_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def append_resume(t: Tables) -> DataFrame:
    return scans.todo(t["orders"].select("o_orderkey"), t["lineitem"].select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


INDEX = "old_ AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'ok' ELSE 'failed' END AS status, p_size AS v FROM part), new_ AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'ok' ELSE 'missing' END AS status, p_size + 100 AS v FROM part WHERE p_partkey % 4 <> 0)"


@query("index_status_merge", f"WITH {INDEX} SELECT o.id, CASE WHEN o.status = 'ok' OR n.id IS NULL THEN o.status ELSE n.status END AS status, CAST(CASE WHEN o.status = 'ok' OR n.id IS NULL THEN o.v ELSE n.v END AS INTEGER) AS v FROM old_ o LEFT JOIN new_ n USING (id)")
def index_status_merge(t: Tables) -> DataFrame:
    p = t["part"]
    old = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "ok").otherwise("failed").alias("status"), F.col("p_size").alias("v"))
    new = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "ok").otherwise("missing").alias("status"), (F.col("p_size") + 100).alias("v"))
    return scans.merge_index(old, new, "id", "status")


@query("failure_split", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'not measured' WHEN quality = 0 THEN 'failed' ELSE 'usable' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def failure_split(t: Tables) -> DataFrame:
    j = t["documents"].select("doc_id").join(t["labels"].select("doc_id", "quality"), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("quality").isNull(), "not measured").when(F.col("quality") == 0, "failed").otherwise("usable").alias("state"))


@query("list_samples", "SELECT c_custkey AS venue, i AS pos, CAST(k AS BIGINT) AS sample FROM (SELECT c_custkey, unnest(l) AS k, unnest(range(len(l))) AS i FROM (SELECT c_custkey, list(o_orderkey ORDER BY o_orderkey) AS l FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1))")
def list_samples(t: Tables) -> DataFrame:
    """Nested lists of a venue to one row a sample."""
    lists = t["customer"].join(t["orders"], F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_custkey").alias("venue")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("papers"))
    return lists.select("venue", F.posexplode("papers").alias("pos", "sample")).select("venue", F.col("pos").cast("long").alias("pos"), "sample")


@query("numbered_events", "SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type AS action FROM events")
def numbered_events(t: Tables) -> DataFrame:
    runs = t["events"].groupBy(F.col("user_id").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("steps"))
    return runs.select("doc", F.posexplode("steps").alias("seq", "s")).select("doc", F.col("seq").cast("long").alias("seq"), F.col("s.event_type").alias("action"))


@query("pairs_load", "SELECT event_id, k FROM (SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events) WHERE k IS NOT NULL")
def pairs_load(t: Tables) -> DataFrame:
    """Objects of a JSON text, either plain or under `pairs`."""
    p = F.from_json("props", "k long, pairs array<struct<k: long>>")
    rows = t["events"].select("event_id", p.alias("p")).select("event_id", F.explode(F.coalesce("p.pairs", F.array(F.struct(F.col("p.k").alias("k"))))).alias("o"))
    return rows.select("event_id", "o.k").where("k is not null")


#: Runs of at most 1,000 numbers of events: no run is longer, however many events a user has.
RUN = 1_000


def _file(t: Tables, text: DataFrame) -> str:
    """A fresh folder of text files, one record a line."""
    path = f"{folder(t.spark)}/foliometry-{uuid.uuid4().hex}"
    text.write.text(path)
    return path


def _states(t: Tables) -> str:
    """Run states as line JSON; those of every 97th user are cut short."""
    run = F.concat_ws("-", F.col("user_id"), F.floor(F.col("event_id") / RUN))
    step = F.struct("event_id", F.col("event_type").alias("action"), (F.col("event_id") % 2 == 0).alias("accepted"), F.col("value").alias("p"))
    runs = t["events"].groupBy("user_id", run.alias("doc")).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    text = F.to_json(F.struct("doc", F.lit("done").alias("status"), "steps"))
    return _file(t, runs.select(F.when(F.col("user_id") % 97 == 0, F.substring(text, 1, 40)).otherwise(text).alias("value")))


RUN_SQL = f"CAST(user_id AS VARCHAR) || '-' || (event_id // {RUN})"


@query("scan_step_traces", f"SELECT {RUN_SQL} AS doc, 'done' AS status, row_number() OVER (PARTITION BY user_id, event_id // {RUN} ORDER BY event_id) - 1 AS seq, event_type AS action, event_id % 2 = 0 AS accepted, value AS p FROM events WHERE user_id % 97 <> 0")
def scan_step_traces(t: Tables) -> DataFrame:
    """Steps of run states, read from files of which some are damaged."""
    return nested.step_traces(t.spark, _states(t), multi_line=False)[0]


@query("scan_damaged_traces", f"""SELECT substr('{{"doc":"' || {RUN_SQL} || '","status":"done","steps":[{{"event_id"', 1, 40) AS text FROM events WHERE user_id % 97 = 0 GROUP BY user_id, event_id // {RUN}""")
def scan_damaged_traces(t: Tables) -> DataFrame:
    """The texts of the damaged run states."""
    return nested.step_traces(t.spark, _states(t), multi_line=False)[1].select("text")


URL = "concat('https://papers.example.org/', CAST(o_orderkey AS STRING), '/', repeat('v%20', CAST(o_orderkey % 40 AS INT)), o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN '.PDF' ELSE '' END)"
TITLE = "concat('Order ', CAST(o_orderkey AS STRING), repeat(' on lines', CAST(o_orderkey % 23 AS INT)))"


@query("scan_sample_lists", f"""WITH o_ AS (SELECT o_orderkey, c_nationkey, {URL.replace("CAST(o_orderkey % 40 AS INT)", "o_orderkey % 40").replace("CAST(o_orderkey % 23 AS INT)", "o_orderkey % 23")} AS url, {TITLE} AS long_title FROM orders JOIN customer ON c_custkey = o_custkey),
n_ AS (SELECT *, regexp_replace(right(regexp_replace(substr(url, 9), '[^A-Za-z0-9._-]', '_', 'g'), 120), '^_+|_+$', '', 'g') AS name FROM o_)
SELECT 'nation ' || c_nationkey AS venue, row_number() OVER (PARTITION BY c_nationkey, o_orderkey // {RUN} ORDER BY o_orderkey) - 1 AS pos, 's' || o_orderkey AS sample_id, CAST(2000 + o_orderkey % 25 AS BIGINT) AS year,
  left(long_title, 120) AS title, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE url END AS pdf_url, CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN lower(name) LIKE '%.pdf' THEN name ELSE name || '.pdf' END END AS cache FROM n_""")
def scan_sample_lists(t: Tables) -> DataFrame:
    """Papers of venue files, read from files."""
    k = F.col("o_orderkey")
    paper = F.struct(k.alias("k"), F.concat(F.lit("s"), k.cast("string")).alias("sample_id"), F.expr(TITLE).alias("title"), (2000 + k % 25).alias("year"), F.when(k % 11 != 0, F.expr(URL)).alias("pdf_url"))
    rows = t["orders"].join(t["customer"], F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", F.floor(k / RUN)).agg(F.sort_array(F.collect_list(paper)).alias("papers"))
    text = F.to_json(F.struct(F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("conference"), "papers"))
    return nested.sample_lists(t.spark, _file(t, rows.select(text.alias("value"))), multi_line=False)[0]


@query("scan_jsonl", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def scan_jsonl(t: Tables) -> DataFrame:
    """Documents written as line JSON with blank lines between, and read back."""
    record = F.to_json(F.struct("doc_id", "text", "lang", "source", "n_chars"))
    lines = t["documents"].select(F.explode(F.when(F.col("doc_id") % 5 == 0, F.array(record, F.lit("  "), F.lit(""))).otherwise(F.array(record))).alias("value"))
    good, _ = nested.json_lines(t.spark, _file(t, lines), "doc_id long, text string, lang string, source string, n_chars long")
    return good.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))
