"""A training corpus from raw documents: language, lines, near copies, benchmark passages, packing.

Defined results: every stage but the last returns the columns of documents and treats each row by its own text. Rows without
a letter, or like no known language, go; of rows alike in id and text one stays; rows that share an id but not a text are
judged each by itself; a row with a null id is no copy of any other and loses no lines; a text that loses all its lines stays, empty; an empty table gives an empty result. Long texts
are read whole. Ties go to the smallest id. Columns beyond those of documents pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliometry.llm import decontaminate, langid, line_dedup, minhash, packing
from foliometry.llm.common import mark, materialize, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with no likeness to any language, go."""
    return langid.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents go, except in the smallest document id; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    dropped = F.col(out.columns[-1]) > 0
    return out.withColumn("n_chars", F.when(dropped, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies stays (five words, similarity 0.8)."""
    return minhash.drop_near_duplicates(docs, width=5, threshold=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that stay; workers of the stages before are still there, so few words are remembered."""
    return packing.pack_documents(docs, packing.default_tokenizer(), most_words=50_000)


STAGES: list[tuple[str, Stage]] = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_copies), ("decontaminate", benchmark), ("packing", pack)]

#: Language prototypes and tokenisation are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        since = mark()
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
