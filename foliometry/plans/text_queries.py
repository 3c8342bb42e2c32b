"""Queries of text, logs, source lines and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliometry.functions import text as tx
from foliometry.functions.scalar import r6
from foliometry.operators import windows
from foliometry.operators.lineage import cut
from foliometry.plans.registry import LINES_SQL, LOGS_SQL, Tables, query, with_views

#: One line is one issue: an hbox by its line or lines in one of three forms, a vbox in one of two, a float warning, an error or another warning.
ISSUE = r"""issue_ AS (SELECT doc, line_no, text, kind,
 CASE WHEN kind IN ('overfull', 'underfull', 'vbox_over', 'vbox_under') THEN CAST(regexp_extract(regexp_extract(text, '\(([^)]*)\)', 1), '[0-9]+[.]?[0-9]*') AS DOUBLE) END AS amount,
 CASE WHEN kind IN ('overfull', 'underfull', 'vbox_over', 'vbox_under') THEN TRY_CAST(regexp_extract(text, ' (?:at lines|detected at line) ([0-9]+)', 1) AS BIGINT) END AS line_lo,
 CASE WHEN kind IN ('overfull', 'underfull') THEN TRY_CAST(regexp_extract(text, ' at lines [0-9]+--([0-9]+)', 1) AS BIGINT) END AS line_hi
 FROM (SELECT *, CASE
   WHEN starts_with(text, 'Overfull \hbox') AND (contains(text, 'in paragraph at lines') OR contains(text, 'in alignment at lines') OR contains(text, 'detected at line')) THEN 'overfull'
   WHEN starts_with(text, 'Underfull \hbox') AND (contains(text, 'in paragraph at lines') OR contains(text, 'in alignment at lines') OR contains(text, 'detected at line')) THEN 'underfull'
   WHEN starts_with(text, 'Overfull \vbox') AND (contains(text, 'has occurred while \output is active') OR contains(text, 'detected at line')) THEN 'vbox_over'
   WHEN starts_with(text, 'Underfull \vbox') AND (contains(text, 'has occurred while \output is active') OR contains(text, 'detected at line')) THEN 'vbox_under'
   WHEN starts_with(text, 'LaTeX Warning: ') AND contains(lower(text), 'float') THEN 'floatwarn' WHEN starts_with(text, '! ') THEN 'error' WHEN starts_with(text, 'LaTeX Warning: ') THEN 'warning' ELSE 'other' END AS kind FROM logs_))"""


def issues(t: Tables) -> DataFrame:
    rows = t.logs.select("doc", "line_no", "text", tx.log_message(F.col("text")).alias("m"))
    return rows.select("doc", "line_no", "text", "m.kind", "m.amount", F.col("m.first").alias("line_lo"), F.col("m.last").alias("line_hi"))


@query("log_issues", with_views(LOGS_SQL, ISSUE, body="SELECT doc, line_no, kind, amount, line_lo, line_hi FROM issue_ WHERE kind <> 'other'"))
def log_issues(t: Tables) -> DataFrame:
    return issues(t).where("kind <> 'other'").drop("text")


@query("log_warning_dedupe", with_views(LOGS_SQL, ISSUE, r"""k_ AS (SELECT doc, line_no, text, row_number() OVER (PARTITION BY doc, regexp_replace(text, ' on input line [0-9]+', '') ORDER BY line_no) AS k FROM issue_ WHERE kind = 'warning')""", body="SELECT doc, line_no, text FROM k_ WHERE k = 1"))
def log_warning_dedupe(t: Tables) -> DataFrame:
    rows = issues(t).where("kind = 'warning'").withColumn("key", F.regexp_replace("text", " on input line [0-9]+", ""))
    return rows.groupBy("doc", "key").agg(F.min_by(F.struct("line_no", "text"), "line_no").alias("r")).select("doc", "r.line_no", "r.text")


@query("log_recount", with_views(LOGS_SQL, ISSUE, body="SELECT doc, kind, count(*) AS n, round(max(amount), 6) AS largest, round(sum(amount), 4) AS total FROM issue_ GROUP BY doc, kind"))
def log_recount(t: Tables) -> DataFrame:
    return issues(t).groupBy("doc", "kind").agg(F.count("*").alias("n"), r6(F.max("amount")).alias("largest"), F.round(F.sum("amount"), 4).alias("total"))


FULL = ("overfull", "underfull", "vbox_over", "vbox_under")


@query("log_miss_rate", with_views(LOGS_SQL, ISSUE, body=r"SELECT doc, count(*) FILTER (WHERE raw) AS raw, count(*) FILTER (WHERE seen) AS perceived, round(1 - count(*) FILTER (WHERE seen) / nullif(count(*) FILTER (WHERE raw), 0), 6) AS miss FROM (SELECT doc, contains(text, 'full \hbox') OR contains(text, 'full \vbox') AS raw, kind IN ('overfull', 'underfull', 'vbox_over', 'vbox_under') AS seen FROM issue_) GROUP BY doc"))
def log_miss_rate(t: Tables) -> DataFrame:
    """Box messages by their plain text, those that a rule reads, and the share that none does."""
    raw = F.col("text").contains("full \\hbox") | F.col("text").contains("full \\vbox")
    g = issues(t).groupBy("doc").agg(F.count_if(raw).alias("raw"), F.count_if(F.col("kind").isin(*FULL)).alias("perceived"))
    return g.withColumn("miss", r6(1 - F.try_divide(F.col("perceived").cast("double"), F.col("raw"))))


@query("scan_logs", with_views(LOGS_SQL, body="SELECT o_custkey AS case_id, count(line_no) AS n_lines FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN logs_ ON doc = o_custkey GROUP BY o_custkey"))
def scan_logs(t: Tables) -> DataFrame:
    """Corpus rows with the number of their log's lines; cases without a log keep their row."""
    logs = t.logs.groupBy("doc").agg(F.count("*").alias("n_lines"))
    return t["orders"].select(F.col("o_custkey").alias("case_id")).distinct().join(logs, F.col("case_id") == F.col("doc"), "left").select("case_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query("interval_join_span", with_views(LOGS_SQL, ISSUE, "span_ AS (SELECT user_id AS doc, event_id % 400 AS lo, event_id % 400 + 12 AS hi FROM events WHERE event_type = 'error')", body="SELECT doc, line_no, line_lo, CASE WHEN EXISTS (SELECT 1 FROM span_ s WHERE s.doc = i.doc AND i.line_lo BETWEEN s.lo - 1 AND s.hi + 1) THEN 'table' ELSE 'text' END AS place FROM issue_ i WHERE kind = 'overfull'"))
def interval_join_span(t: Tables) -> DataFrame:
    """Overfull lines inside any span (one line of slack) are of a table. Buckets of 64 lines make the range join an equi-join."""
    over = issues(t).where("kind = 'overfull'").select("doc", "line_no", "line_lo")
    e = F.col("event_id") % 400
    spans = t["events"].where("event_type = 'error'").select(F.col("user_id").alias("doc"), (e - 1).alias("lo"), (e + 13).alias("hi"))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / 64), F.floor(F.col("hi") / 64))))
    left = over.withColumn("cell", F.floor(F.col("line_lo") / 64)).alias("o")
    hit = left.join(cells.alias("s"), (F.col("o.doc") == F.col("s.doc")) & (F.col("o.cell") == F.col("s.cell")) & F.col("line_lo").between(F.col("lo"), F.col("hi")), "left_semi").select("line_no", F.lit(True).alias("hit"))
    return over.join(hit, "line_no", "left").select("doc", "line_no", "line_lo", F.when(F.col("hit"), "table").otherwise("text").alias("place"))


@query("asof_line_page", """SELECT i.event_id, i.user_id AS doc, (SELECT max_by(a.value, a.event_id) FROM events a WHERE a.user_id = i.user_id AND a.event_type = 'view' AND a.event_id <= i.event_id) AS page FROM events i WHERE i.event_type = 'click'""")
def asof_line_page(t: Tables) -> DataFrame:
    e = t["events"].select(F.col("user_id").alias("doc"), "event_id", "value", "event_type")
    items, anchors = e.where("event_type = 'click'").select("doc", "event_id"), e.where("event_type = 'view'").select("doc", "event_id", F.col("value").alias("page"))
    return windows.as_of(items, anchors, "doc", "event_id", "page").select("event_id", "doc", "page")


TITLE = r"""regexp_extract(html, '<title>([^<]*)</title>', 1)"""
UNESC = "{x}"
for _a, _b in tx.ENTITIES:
    UNESC = f"replace({UNESC}, '{_a}', '{_b.replace(chr(39), 2 * chr(39))}')"


@query("text_norm_title", "SELECT page_id, trim(regexp_replace(" + UNESC.format(x=TITLE) + ", '[ \\t\\n\\r]+', ' ', 'g'), ' .·-') AS title FROM pages")
def text_norm_title(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", tx.norm_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


NORM = "lower(trim(regexp_replace({x}, '[ \\t\\n\\r]+', ' ', 'g')))"


@query("text_norm_quote", "SELECT doc_id, md5(" + NORM.format(x="text") + ") AS norm_md5 FROM documents")
def text_norm_quote(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", F.md5(tx.norm_quote(F.col("text")).cast("binary")).alias("norm_md5"))


HTML = "html"
for _t in ("script", "style", "noscript"):
    HTML = f"regexp_replace({HTML}, '<{_t}[^>]*>.*?</{_t}>', ' ', 'gis')"
HTML = UNESC.format(x=f"regexp_replace(regexp_replace({HTML}, '<br\\s*/?>|</(?:p|div|li|tr|h[1-6]|section|article)>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')")
HTML = f"trim(regexp_replace(regexp_replace({HTML}, '[ \\t' || chr(160) || ']+', ' ', 'g'), '\\n[ \\n]*\\n[ \\n]*\\n+', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(13) || chr(10))"


@query("html_to_text", f"SELECT page_id, length({HTML}) AS n, md5({HTML}) AS text_md5 FROM pages")
def html_to_text(t: Tables) -> DataFrame:
    x = t["pages"].select("page_id", tx.html_text(F.col("html")).alias("x"))
    return x.select("page_id", F.length("x").cast("long").alias("n"), F.md5(F.col("x").cast("binary")).alias("text_md5"))


@query("link_extract", """SELECT page_id, i AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS url, regexp_extract(a, '>([^<]*)<', 1) AS title FROM (SELECT page_id, unnest(l) AS a, unnest(range(len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages))""")
def link_extract(t: Tables) -> DataFrame:
    """Links of index pages with their place, address and title."""
    links = t["pages"].select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">[^<]*</a>'), F.lit(0))).alias("pos", "a"))
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("a", 'href="([^"]*)"', 1).alias("url"), F.regexp_extract("a", ">([^<]*)<", 1).alias("title"))


@query("link_candidates", r"""SELECT page_id, array_to_string(list_filter(list_distinct_(f), lambda x: x <> url), ' ') AS candidates FROM (SELECT page_id, url, [regexp_replace(url, '#.*$', ''), regexp_replace(url, '^http://', 'https://'), regexp_replace(url, '^(https?://)m\.', '\1'), lower(url), regexp_replace(url, '\?.*$', '')] AS f FROM pages)""".replace("list_distinct_(f)", "list_filter(f, lambda x, i: list_position(f, x) = i)"))
def link_candidates(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", F.array_join(tx.link_candidates(F.col("url")), " ").alias("candidates"))


@query("caption_kind", with_views(LINES_SQL, body=r"""SELECT doc, line, CASE WHEN lower(s) LIKE 'fig%' THEN 'figure' WHEN lower(s) LIKE 'tab%' THEN 'table' END AS kind FROM (SELECT doc, line, regexp_extract(text, '^\s*(?i:(fig(?:ure|\.)?|tab(?:le|\.)?))\s*[0-9]+', 1) AS s FROM lines_)"""))
def caption_kind(t: Tables) -> DataFrame:
    return t.lines.select("doc", "line", tx.caption_kind(F.col("text")).alias("kind"))


@query("heading_predicates", with_views(LINES_SQL, body=r"""SELECT doc, line, length(text) <= 90 AND NOT regexp_matches(text, '[.!?:;,]$') AND regexp_matches(text, '^[A-Z0-9]') AS heading, contains(lower(text), 'license') AS refs FROM lines_"""))
def heading_predicates(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.lines.select("doc", "line", ((F.length(x) <= 90) & ~x.rlike("[.!?:;,]$") & x.rlike("^[A-Z0-9]")).alias("heading"), F.lower(x).contains("license").alias("refs"))


#: Tasks over which the copies of one body are dealt.
DEALT = 16
BODY = r"regexp_replace(regexp_replace(replace({x}, '|', ''), '[#$%&*]{{3}}', '', 'g'), '[ \t\n\r]+', '', 'g')"


@query("equal_pairs", f"WITH v AS (SELECT doc_id, source, md5({BODY.format(x='text')}) AS body FROM documents) SELECT a.doc_id AS a, b.doc_id AS b FROM v a JOIN v b ON a.body = b.body AND a.doc_id < b.doc_id AND a.source = b.source")
def equal_pairs(t: Tables) -> DataFrame:
    """Pairs of versions (of one source) whose bodies are equal after removing layout; found by hash."""
    v = t["documents"].select("doc_id", "source", F.md5(tx.strip_layout(F.col("text")).cast("binary")).alias("body"))
    return v.alias("a").join(v.alias("b"), (F.col("a.body") == F.col("b.body")) & (F.col("a.source") == F.col("b.source")) & (F.col("a.doc_id") < F.col("b.doc_id"))).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"))


@query("content_groups", f"WITH v AS (SELECT doc_id, md5({BODY.format(x='text')}) AS body FROM documents WHERE text IS NOT NULL) SELECT doc_id, first, n FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS first, count(*) OVER (PARTITION BY body) AS n FROM v) WHERE n > 1")
def content_groups(t: Tables) -> DataFrame:
    """Every version that shares its body with another of any source, with the smallest id of that body and the number of versions.

    A body's versions are dealt over several tasks when they meet its count, so a body with very many copies makes no large task.
    """
    v = t["documents"].select("doc_id", F.unhex(F.md5(tx.strip_layout(F.col("text")).cast("binary"))).alias("body")).where("body is not null")
    bodies = v.groupBy("body").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    dealt = bodies.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    return v.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(DEALT)).cast("int")).join(dealt, ["body", "part"]).select("doc_id", "first", "n")


@query("block_print", with_views(LINES_SQL, body="SELECT doc, sha256(string_agg(regexp_replace(lower(text), '[^a-z]', '', 'g'), '|' ORDER BY line)) AS print FROM lines_ WHERE length(text) < 60 GROUP BY doc"))
def block_print(t: Tables) -> DataFrame:
    """Hash of a document's short blocks in order."""
    short = t.lines.where(F.length("text") < 60).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("line", F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("x")))).alias("b"))
    return short.select("doc", F.sha2(F.array_join("b.x", "|").cast("binary"), 256).alias("print"))


@query("multiset_deviation", """WITH p AS (SELECT text, min(doc_id) AS a FROM documents GROUP BY source, substr(text, 1, 40), text), v AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS nxt FROM documents), c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\s\\S]')) AS ch FROM documents) GROUP BY 1, 2),
x AS (SELECT v.doc_id AS a, v.nxt AS b, c.ch, c.n AS na, 0 AS nb FROM v JOIN c ON c.doc_id = v.doc_id WHERE nxt IS NOT NULL UNION ALL SELECT v.doc_id, v.nxt, c.ch, 0, c.n FROM v JOIN c ON c.doc_id = v.nxt)
SELECT a, b, round(1 - sum(least(na, nb)) / sum(greatest(na, nb)), 6) AS deviation FROM (SELECT a, b, ch, sum(na) AS na, sum(nb) AS nb FROM x GROUP BY a, b, ch) GROUP BY a, b""")
def multiset_deviation(t: Tables) -> DataFrame:
    """1 - bag Jaccard of the characters of each document and the next of its source. Counts are taken before any join."""
    docs = t["documents"]
    chars = docs.select("doc_id", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("doc_id", "ch").agg(F.count("*").alias("n"))
    pairs = docs.select(F.col("doc_id").alias("a"), F.lead("doc_id").over(W.partitionBy("source").orderBy("doc_id")).alias("b")).where("b is not null")
    left = pairs.join(chars, F.col("a") == F.col("doc_id")).select("a", "b", "ch", F.col("n").alias("na"), F.lit(0).alias("nb"))
    right = pairs.join(chars, F.col("b") == F.col("doc_id")).select("a", "b", "ch", F.lit(0).alias("na"), F.col("n").alias("nb"))
    both = left.unionByName(right).groupBy("a", "b", "ch").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    return both.groupBy("a", "b").agg(r6(1 - F.sum(F.least("na", "nb")) / F.sum(F.greatest("na", "nb"))).alias("deviation"))


@query("edit_cost", """SELECT a.o_orderkey AS k, round(0.5 * abs(a.o_totalprice - b.p) / 1000 + 3 * abs(length(a.o_orderpriority) - b.l) + 0.4 * len(list_filter(range(1, least(length(a.o_orderpriority), b.l) + 1), lambda i: substr(a.o_orderpriority, i, 1) <> substr(b.w, i, 1))), 6) AS cost
FROM orders a JOIN (SELECT o_orderkey + 1 AS k, o_totalprice AS p, o_orderpriority AS w, length(o_orderpriority) AS l FROM orders) b ON a.o_orderkey = b.k""")
def edit_cost(t: Tables) -> DataFrame:
    """Cost of the change from one version to the next: margin, size and place-by-place differences of the shorter list."""
    o = t["orders"].select("o_orderkey", "o_totalprice", "o_orderpriority")
    nxt = o.select((F.col("o_orderkey") + 1).alias("k"), F.col("o_totalprice").alias("p"), F.col("o_orderpriority").alias("w"))
    n = F.least(F.length("o_orderpriority"), F.length("w"))
    parts = lambda c: F.slice(F.split(c, ""), 1, n)
    differ = F.size(F.filter(F.zip_with(parts(F.col("o_orderpriority")), parts(F.col("w")), lambda x, y: x != y), lambda z: z))
    cost = 0.5 * F.abs(F.col("o_totalprice") - F.col("p")) / 1000 + 3 * F.abs(F.length("o_orderpriority") - F.length("w")) + 0.4 * differ
    return o.join(nxt, o.o_orderkey == nxt.k).select("k", r6(cost).alias("cost"))


#: Characters of an anchor, and the one that it begins with.
ANCHOR, ANCHOR_AT = 12, "t"


@query("quote_provenance", f"WITH b AS (SELECT item_id, {NORM.format(x='text')} AS q FROM benchmark), d AS (SELECT doc_id, {NORM.format(x='text')} AS t FROM documents) SELECT item_id, count(doc_id) AS n_sources, min(doc_id) AS first_source FROM b LEFT JOIN d ON contains(t, q) OR contains(replace(t, ' ', ''), replace(q, ' ', '')) GROUP BY item_id")
def quote_provenance(t: Tables) -> DataFrame:
    """In which archived texts a quote stands, as it is or without blanks. The latter holds wherever the former does.

    A quote's anchor is its first run of ANCHOR characters (without blanks) that begins with ANCHOR_AT; each text gives all such
    runs, so whatever holds the quote holds the anchor. The quotes' hashes, as far as they fit a broadcast, filter the runs where
    the texts are scanned. Quotes without an anchor are compared with every text.
    """
    glue = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    runs = F.regexp_extract_all("g", F.lit(f"(?=({ANCHOR_AT}.{{{ANCHOR - 1}}}))"), F.lit(1))
    docs = t["documents"].select("doc_id", glue(tx.norm_quote(F.col("text"))).alias("g"))
    quotes = t["benchmark"].select("item_id", glue(tx.norm_quote(F.col("text"))).alias("q"))
    keyed = cut(quotes.withColumn("key", F.xxhash64(F.get(F.regexp_extract_all("q", F.lit(f"(?=({ANCHOR_AT}.{{{ANCHOR - 1}}}))"), F.lit(1)), F.lit(0)))).withColumn("anchored", F.col("q").rlike(f"{ANCHOR_AT}.{{{ANCHOR - 1}}}")))
    spots = docs.select("doc_id", "g", F.explode(F.array_distinct(F.transform(runs, lambda r: F.xxhash64(r)))).alias("key"))
    met = spots.join(keyed.where("anchored").select("key", "item_id", "q"), "key")
    plain = docs.join(F.broadcast(keyed.where("not anchored").select("item_id", "q")), F.col("g").contains(F.col("q")))
    found = met.where(F.col("g").contains(F.col("q"))).select("item_id", "doc_id").union(plain.select("item_id", "doc_id")).distinct()
    counts = found.groupBy("item_id").agg(F.count("*").alias("n_sources"), F.min("doc_id").alias("first_source"))
    return quotes.select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "first_source")


@query("venue_in_source", "SELECT doc_id, contains(lower(text), lower(source)) AS found, contains(text, lang) AS lang_found FROM documents")
def venue_in_source(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", F.lower("text").contains(F.lower("source")).alias("found"), F.col("text").contains(F.col("lang")).alias("lang_found"))


@query("distinct_captures", r"""SELECT doc_id, count(DISTINCT m) AS n_distinct, count(m) AS n_all FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]{4,})', 1)) AS m FROM documents) GROUP BY doc_id""")
def distinct_captures(t: Tables) -> DataFrame:
    rows = t["documents"].select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9]{4,})"), F.lit(1))).alias("m"))
    return rows.groupBy("doc_id").agg(F.count_distinct("m").alias("n_distinct"), F.count("m").alias("n_all"))


RULES = {"bars": r"[|]", "shout": r"!!", "symbols": r"[#$%&*]{3}", "long_number": r"[0-9]{9,}", "mail": r"@", "assign": r" = ", "double_word": r"(?i)\bthe the\b"}


@query("line_rules", with_views(LINES_SQL, body=" UNION ALL ".join(f"SELECT doc, line, '{k}' AS kind, regexp_extract(text, '{p}') AS detail FROM lines_ WHERE regexp_matches(text, '{p}') AND NOT starts_with(text, '%')" for k, p in RULES.items())))
def line_rules(t: Tables) -> DataFrame:
    """Line rules over source lines (comments left out): one pass, a row for each rule that fires."""
    rules = F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", p, 0).alias("detail"))) for k, p in RULES.items()])
    hits = t.lines.where(~F.col("text").startswith("%")).select("doc", "line", F.explode(F.array_compact(rules)).alias("h"))
    return hits.select("doc", "line", "h.kind", "h.detail")


@query("long_numbers", with_views(LINES_SQL, body=r"""SELECT doc, line, i AS pos, m AS number, TRY_CAST(m AS DOUBLE) > 1e12 AS wide FROM (SELECT doc, line, unnest(l) AS m, unnest(range(len(l))) AS i FROM (SELECT doc, line, regexp_extract_all(text, '[0-9]{3,}') AS l FROM lines_))"""))
def float_inventory(t: Tables) -> DataFrame:
    found = t.lines.select("doc", "line", F.posexplode(F.regexp_extract_all("text", F.lit("[0-9]{3,}"), F.lit(0))).alias("pos", "number"))
    return found.select("doc", "line", F.col("pos").cast("long").alias("pos"), "number", (F.col("number").try_cast("double") > 1e12).alias("wide"))


@query("text_facts", r"""SELECT doc_id, regexp_extract(text, '^(\S+)', 1) AS first_word, len(string_split(text, chr(10))) AS n_lines, contains(text, '@') AS has_mail, coalesce(TRY_CAST(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS DOUBLE), 10.0) AS first_number FROM documents""")
def source_facts(t: Tables) -> DataFrame:
    x = F.col("text")
    return t["documents"].select(
        "doc_id", F.regexp_extract(x, r"^(\S+)", 1).alias("first_word"), F.size(F.split(x, "\n", -1)).cast("long").alias("n_lines"), x.contains("@").alias("has_mail"),
        F.coalesce(F.nullif(F.regexp_extract(x, "([0-9]+)", 1), F.lit("")).try_cast("double"), F.lit(10.0)).alias("first_number"),
    )


@query("text_levels", "SELECT doc_id, lv AS level, length(CASE lv WHEN 1 THEN replace(text, '. ', '.') WHEN 2 THEN replace(replace(text, '. ', '.'), ', ', ',') ELSE replace(replace(replace(text, '. ', '.'), ', ', ','), ' the ', ' ') END) AS n FROM documents, (SELECT unnest([1, 2, 3]) AS lv)")
def degrade_text(t: Tables) -> DataFrame:
    """Cumulative degradations of a text by level."""
    steps = [lambda c: F.replace(c, F.lit(". "), F.lit(".")), lambda c: F.replace(c, F.lit(", "), F.lit(",")), lambda c: F.replace(c, F.lit(" the "), F.lit(" "))]
    forms, c = [], F.col("text")
    for k, f in enumerate(steps, 1):
        c = f(c)
        forms.append(F.struct(F.lit(k).alias("level"), F.length(c).cast("long").alias("n")))
    return t["documents"].select("doc_id", F.explode(F.array(*forms)).alias("d")).select("doc_id", "d.level", "d.n")


@query("body_extract", r"""SELECT doc_id, length(regexp_replace(regexp_extract(text, '\n([\s\S]*)\n', 1), '[0-9]{9,}', '', 'g')) AS n FROM documents""")
def body_extract(t: Tables) -> DataFrame:
    """Text between the first and last line break, long numbers removed."""
    return t["documents"].select("doc_id", F.length(F.regexp_replace(F.regexp_extract("text", r"\n([\s\S]*)\n", 1), "[0-9]{9,}", "")).cast("long").alias("n"))


@query("env_spans", """WITH e AS (SELECT user_id AS doc, event_id AS pos, CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type IN ('purchase', 'signup') THEN -1 ELSE 0 END AS d FROM events), r AS (SELECT *, sum(d) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth FROM e WHERE d <> 0),
o AS (SELECT doc, pos, d, CASE WHEN d = 1 THEN depth ELSE depth + 1 END AS level FROM r), n AS (SELECT *, lead(pos) OVER (PARTITION BY doc, level ORDER BY pos) AS close, lead(d) OVER (PARTITION BY doc, level ORDER BY pos) AS nd FROM o)
SELECT doc, pos AS open, close, CAST(level AS BIGINT) AS level FROM n WHERE d = 1 AND nd = -1""")
def env_spans(t: Tables) -> DataFrame:
    """Begin and end marks paired by depth: an end closes the last open mark of its level."""
    d = F.when(F.col("event_type").isin("click", "view"), 1).when(F.col("event_type").isin("purchase", "signup"), -1)
    w = W.partitionBy("doc").orderBy("pos")
    marks = t["events"].select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), d.alias("d")).where("d is not null")
    depth = F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0))
    level = marks.withColumn("level", F.when(F.col("d") == 1, depth).otherwise(depth + 1))
    v = W.partitionBy("doc", "level").orderBy("pos")
    paired = level.select("doc", "pos", "d", "level", F.lead("pos").over(v).alias("close"), F.lead("d").over(v).alias("nd"))
    return paired.where("d = 1 and nd = -1").select("doc", F.col("pos").alias("open"), "close", F.col("level").cast("long").alias("level"))
