"""Files of nested records: run states with their steps, venue files with their papers, line JSON; damaged records apart.

Every reader takes a schema, so fields that a file lacks are null, others are passed over, and a value of another type makes
its record a damaged one. Nothing is cached: a damaged record is told by its kept text, read in the same scan as its fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAD = "_damaged"
STATE = "doc string, status string, steps array<struct<action: string, accepted: boolean, p: double>>"
VENUE = "conference string, papers array<struct<sample_id: string, title: string, year: long, pdf_url: string>>"
#: Longest title and longest cache name, in code points.
TITLE = NAME = 120


def _records(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    reader = spark.read.schema(f"{schema}, {BAD} string").option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"))


def _split(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole records, and file and text of damaged ones.

    A record is judged by all its fields, whatever a query goes on to read: the hash keeps them in the scan, where a value of
    another type would else go unseen in a field that nobody reads.
    """
    fields = [c for c in raw.columns if c not in (BAD, "file", "file_name")]
    text = F.when(F.try_divide(F.xxhash64(*fields), F.lit(1)).isNotNull(), F.col(BAD))
    return raw.where(text.isNull()).drop(BAD), raw.where(text.isNotNull()).select("file", F.col(BAD).alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of line JSON, and the damaged lines. Blank lines are no records."""
    good, bad = _split(_records(spark, path, schema, False))
    return good.drop("file", "file_name"), bad


def step_traces(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """One row a step of each run state, in order from 0, with the run's status; and the damaged files.

    A run without a name is called by its file. A run without steps gives no rows.
    """
    good, bad = _split(_records(spark, path, STATE, multi_line))
    steps = good.select(F.coalesce("doc", "file").alias("doc"), "status", F.posexplode("steps").alias("seq", "s"))
    return steps.select("doc", "status", F.col("seq").cast("long").alias("seq"), "s.action", "s.accepted", "s.p"), bad


def cache_name(url: Column) -> Column:
    """Name of a cached file: the address after its first //, odd characters as _, the last 120, no _ at the ends, .pdf added."""
    tail = F.when(F.instr(url, "//") > 0, F.substring(url, F.instr(url, "//") + 2, F.char_length(url))).otherwise(url)
    plain = F.regexp_replace(tail, r"[^A-Za-z0-9._-]", "_")
    name = F.regexp_replace(F.right(plain, F.lit(NAME)), "^_+|_+$", "")
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def sample_lists(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """One row a paper of each venue file; the venue in lower case, else the file's name up to its first point; and the damaged files."""
    good, bad = _split(_records(spark, path, VENUE, multi_line))
    venue = F.lower(F.coalesce(F.nullif("conference", F.lit("")), F.substring_index("file_name", ".", 1)))
    rows = good.select(venue.alias("venue"), F.posexplode("papers").alias("pos", "s"))
    url = F.nullif("s.pdf_url", F.lit(""))
    return rows.select(
        "venue", F.col("pos").cast("long").alias("pos"), "s.sample_id", F.col("s.year").alias("year"), F.substring(F.coalesce("s.title", F.lit("")), 1, TITLE).alias("title"),
        F.coalesce("s.pdf_url", F.lit("")).alias("pdf_url"), cache_name(url).alias("cache"),
    ), bad
