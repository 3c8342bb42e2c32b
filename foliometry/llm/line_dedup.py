"""Removal of lines that repeat across documents.

Lines are exploded, normalised (blanks stripped at both ends, A-Z lower-cased) and hashed to 128 bits; distinct
documents per hash are counted with a partial aggregate before the shuffle; lines over the threshold go,
except in the smallest document that holds them; the others are put together again by position.

Lines are hashed once, to a table of hashes and positions. The join from repeated hashes back to the lines has two parts: a
hash that holds more than one line in HOT of all is one of HOT hashes at most, so these are broadcast and their lines stay
where they are; every other hash is too small to fill a task. Each text is shuffled once, to meet its own list of dropped
positions.

Defined results: a null or empty text has one empty line and keeps it; a key shorter than min_chars code points never
goes; a line that repeats inside one document only stays; rows of the same id count as one document, and each of them loses
its own lines; a row with a null id counts for no document and keeps all its lines; an empty table gives an empty
result; other columns pass through, and the two new ones get underscores before their names where a column has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliometry.llm.common import free_name, lower_ascii, materialize

EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANK_CHARS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


#: A hash with more than one line in so many is joined by broadcast; there are at most so many of them.
HOT = 2_000


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `text` replaced by the lines that stay and two more columns at the end, n_lines and n_dropped.

    min_docs: a key found in at least so many distinct documents loses its lines, except in the smallest id.
    """
    # a row is known by its id and its text's hash: rows alike in both lose the same lines
    row_key = [F.col(doc_id).cast("long").alias("d"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]
    line = (
        docs.where(F.col(doc_id).isNotNull() & (F.char_length(text) >= min_chars))
        .select(*row_key, F.posexplode(_lines(F.col(text))).alias("pos", "line"))
        .select("d", "t1", "t2", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("d", "t1", "t2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    line = materialize(line, "lines")
    per_key = line.groupBy("h1", "h2").agg(
        F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("lines"), *([F.count_distinct("d").alias("n")] if min_docs > 2 else [])
    )
    frequent = per_key.where("first <> last").where(F.col("n") >= min_docs if min_docs > 2 else F.lit(True)).select("h1", "h2", "first", "lines")
    frequent = materialize(frequent, "frequent")
    hot = F.col("lines") > F.lit(max(1, line.count() // HOT))
    gone = [line.join(side, ["h1", "h2"]).where("d <> first").select("d", "t1", "t2", "pos") for side in (F.broadcast(frequent.where(hot)), frequent.where(~hot))]
    dropped = gone[0].union(gone[1]).groupBy("d", "t1", "t2").agg(F.collect_set("pos").alias("dropped"))
    dropped = dropped.toDF("__d", "__t1", "__t2", "__dropped").hint("merge")  # the lists grow with the documents
    # the row goes along as one value, so no name of its columns can clash
    rows = docs.select(F.struct(*docs.columns).alias("__row"), *[c.alias(f"__{n}") for c, n in zip(row_key, ("d", "t1", "t2"), strict=True)])
    joined = rows.join(dropped, ["__d", "__t1", "__t2"], "left")
    own, gone_at = F.col("__row")[text], F.col("__dropped")
    joined = joined.withColumn("__lines", F.when(gone_at.isNotNull(), _lines(own)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone_at), lambda i: F.col("__lines")[i])
    n_lines = F.when(gone_at.isNull(), F.char_length(F.regexp_replace(F.coalesce(own, F.lit("")), "[^\n]", "")) + 1).otherwise(F.size("__lines"))
    return joined.select(
        *[F.when(gone_at.isNull(), own).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col("__row")[c].alias(c) for c in docs.columns],
        n_lines.cast("long").alias(free_name(docs, "n_lines")), F.coalesce(F.size(gone_at), F.lit(0)).cast("long").alias(free_name(docs, "n_dropped")),
    )


def query(docs: DataFrame) -> DataFrame:
    """The digest columns of the query: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH line AS (
  SELECT doc_id, i - 1 AS pos, l[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) t, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), frequent AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, (f.key IS NOT NULL AND k.doc_id <> f.first_doc) AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
