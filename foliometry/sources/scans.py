"""Readers and writers: page documents, manifests, incremental indexes, profile tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def page_docs(spark: SparkSession, folder: str, schema: T.StructType, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """One JSON file (or line) a paper to page rows, and the files that could not be read. schema has an array of structs `pages`."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    raw = spark.read.schema(full).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder)
    raw = raw.withColumn("file", F.col("_metadata.file_name"))
    text = F.when(F.try_divide(F.xxhash64(*schema.names), F.lit(1)).isNotNull(), F.col("_bad"))  # judged by all fields, whatever is read of them
    rows = raw.where(text.isNull()).select("file", *[f for f in schema.names if f != "pages"], F.explode("pages").alias("page"))
    return rows, raw.where(text.isNotNull()).select("file", "_bad")


def docs_by_id(docs: DataFrame, ids: DataFrame, key: str, pages: str) -> DataFrame:
    """Documents of an id table that have at least one page."""
    return docs.join(ids.select(key).distinct(), key, "left_semi").where(F.size(pages) > 0)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key: one row a key leaves each task."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*")


def manifest_ok(manifest: DataFrame, meta: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """Manifest rows with status ok, with the last metadata record of their key."""
    return manifest.where(F.col(status) == "ok").join(latest(meta, key, order), key, "left")


def todo(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet; results are then appended."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def merge_index(old: DataFrame, new: DataFrame, key: str, status: str) -> DataFrame:
    """Ok rows of the old index stay; others are replaced by the new row where there is one."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    rank = F.when((F.col("__age") == 0) & (F.col(status) == "ok"), 2).otherwise(F.col("__age"))
    w = W.partitionBy(key).orderBy(F.desc(rank))
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__age")


def write_profile(df: DataFrame, path: str, partition: str = "level") -> None:
    """Replaces a profile table; the job's commit makes the change whole or not at all."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)
