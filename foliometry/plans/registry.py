"""Registered queries: a name, a function of the tables, and DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliometry.operators.flatten import to_long
from foliometry.operators.lineage import cut


class Tables:
    """The driver's tables under one folder, and the views of them that stand for layout data."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def pages(self) -> DataFrame:
        """Page rows: paper, page, venue, role, layout and six measures."""
        order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
        lines, supplier = self["lineitem"], self["supplier"].select("s_suppkey", "s_nationkey")
        return lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).select(
            F.col("l_suppkey").alias("paper"), F.row_number().over(order).cast("long").alias("page"), F.col("s_nationkey").cast("long").alias("venue"),
            F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("layout"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
        )

    @cached_property
    def long(self) -> DataFrame:
        """One row for each page and measure."""
        return to_long(self.pages, IDS, DIMS)

    @cached_property
    def written(self) -> DataFrame:
        """Page rows that are written once, for queries that read them several times."""
        return cut(self.pages)

    @cached_property
    def kept(self) -> DataFrame:
        """One row for each page and measure, from these."""
        return to_long(self.written, IDS, DIMS)

    @cached_property
    def lines(self) -> DataFrame:
        """Lines of documents: doc, line, text, lang, source."""
        return self["documents"].select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).select(F.col("doc_id").alias("doc"), F.col("line").cast("long").alias("line"), "text", "lang", "source")

    @cached_property
    def logs(self) -> DataFrame:
        """Compile-log lines made from events: doc, line_no, text. A kind's events give its forms by their number modulo 3."""
        v, k, form = F.format_string("%.2f", "value"), F.col("event_id") % 500, F.col("event_id") % 3
        at = lambda n: F.concat(k.cast("string"), F.lit("--"), (k + n).cast("string"))
        kind = F.col("event_type")
        text = (
            F.when((kind == "click") & (form == 0), F.concat(F.lit("Overfull \\hbox ("), v, F.lit("pt too wide) in paragraph at lines "), at(3)))
            .when((kind == "click") & (form == 1), F.concat(F.lit("Overfull \\hbox ("), v, F.lit("pt too wide) detected at line "), k.cast("string")))
            .when(kind == "click", F.concat(F.lit("Overfull \\hbox ("), v, F.lit("pt too wide) in alignment at lines "), at(9)))
            .when((kind == "view") & (form < 2), F.concat(F.lit("Underfull \\hbox (badness "), (F.floor("value") % 10000).cast("string"), F.lit(") in paragraph at lines "), at(1)))
            .when(kind == "view", F.concat(F.lit("Underfull \\hbox (badness "), (F.floor("value") % 10000).cast("string"), F.lit(") detected at line "), k.cast("string")))
            .when((kind == "purchase") & (form == 0), F.concat(F.lit("Overfull \\vbox ("), v, F.lit("pt too high) has occurred while \\output is active []")))
            .when((kind == "purchase") & (form == 1), F.concat(F.lit("Overfull \\vbox ("), v, F.lit("pt too high) detected at line "), k.cast("string")))
            .when(kind == "purchase", F.concat(F.lit("Underfull \\vbox (badness "), (F.floor("value") % 10000).cast("string"), F.lit(") has occurred while \\output is active []")))
            .when((kind == "signup") & (form < 2), F.concat(F.lit("LaTeX Warning: Reference `r"), (k % 7).cast("string"), F.lit("' undefined on input line "), k.cast("string"), F.lit(".")))
            .when(kind == "signup", F.concat(F.lit("LaTeX Warning: Float too large for page by "), v, F.lit("pt on input line "), k.cast("string"), F.lit(".")))
            .otherwise(F.concat(F.lit("! Undefined control sequence "), (k % 5).cast("string")))
        )
        return self["events"].select(F.col("user_id").alias("doc"), F.col("event_id").alias("line_no"), text.alias("text"))


IDS = ["paper", "page", "venue", "role", "layout"]
DIMS = ["quantity", "price", "discount", "tax", "unit_price", "net_price"]
PAGES_SQL = """
pages_ AS (
  SELECT l_suppkey AS paper, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS page,
         CAST(s_nationkey AS BIGINT) AS venue, l_returnflag AS role, l_linestatus AS layout, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount,
         l_tax AS tax, l_extendedprice / l_quantity AS unit_price, l_extendedprice * (1 - l_discount) AS net_price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
LONG_SQL = PAGES_SQL + """, long_ AS (UNPIVOT pages_ ON quantity, price, discount, tax, unit_price, net_price INTO NAME dim VALUE value)"""
LINES_SQL = """
lines_ AS (SELECT doc_id AS doc, CAST(i - 1 AS BIGINT) AS line, l[i] AS text, lang, source
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents) t, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"""
LOGS_SQL = """
logs_ AS (SELECT user_id AS doc, event_id AS line_no, CASE
  WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'Overfull \\hbox (' || printf('%.2f', value) || 'pt too wide) in paragraph at lines ' || (event_id % 500) || '--' || (event_id % 500 + 3)
  WHEN event_type = 'click' AND event_id % 3 = 1 THEN 'Overfull \\hbox (' || printf('%.2f', value) || 'pt too wide) detected at line ' || (event_id % 500)
  WHEN event_type = 'click' THEN 'Overfull \\hbox (' || printf('%.2f', value) || 'pt too wide) in alignment at lines ' || (event_id % 500) || '--' || (event_id % 500 + 9)
  WHEN event_type = 'view' AND event_id % 3 < 2 THEN 'Underfull \\hbox (badness ' || (CAST(floor(value) AS BIGINT) % 10000) || ') in paragraph at lines ' || (event_id % 500) || '--' || (event_id % 500 + 1)
  WHEN event_type = 'view' THEN 'Underfull \\hbox (badness ' || (CAST(floor(value) AS BIGINT) % 10000) || ') detected at line ' || (event_id % 500)
  WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'Overfull \\vbox (' || printf('%.2f', value) || 'pt too high) has occurred while \\output is active []'
  WHEN event_type = 'purchase' AND event_id % 3 = 1 THEN 'Overfull \\vbox (' || printf('%.2f', value) || 'pt too high) detected at line ' || (event_id % 500)
  WHEN event_type = 'purchase' THEN 'Underfull \\vbox (badness ' || (CAST(floor(value) AS BIGINT) % 10000) || ') has occurred while \\output is active []'
  WHEN event_type = 'signup' AND event_id % 3 < 2 THEN 'LaTeX Warning: Reference `r' || (event_id % 500 % 7) || ''' undefined on input line ' || (event_id % 500) || '.'
  WHEN event_type = 'signup' THEN 'LaTeX Warning: Float too large for page by ' || printf('%.2f', value) || 'pt on input line ' || (event_id % 500) || '.'
  ELSE '! Undefined control sequence ' || (event_id % 500 % 5) END AS text FROM events)"""

Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def with_views(*views: str, body: str) -> str:
    return "WITH " + ", ".join(v.strip() for v in views) + "\n" + body


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: QUERIES[name](Tables(spark, sf_dir))
