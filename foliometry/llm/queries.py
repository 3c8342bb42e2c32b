"""The training-data operators' queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliometry.llm import alignment, byte_bpe, decontaminate, embedding_dedup, langid, lexical_search, license_scan, line_dedup, lm, minhash, packing, pii, quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.query(_table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.query(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(_table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.query(_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.query(_table(spark, sf_dir, "embeddings"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.query(_table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.query(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_license_scan, op3_minhash, op4_line_dedup, op5_quality, op6_pii, op7_packing, op8_language, op9_lm_score, op10_embedding_dedup,
        op11_search, op12_alignment, op13_byte_bpe,
    )
}
#: DuckDB SQL for the same rows; the others are tested against brute force, exact round trips or held-out accuracy.
SQL: dict[str, str] = {"op1_decontaminate": decontaminate.SQL, "op3_minhash": minhash.SQL, "op4_line_dedup": line_dedup.SQL, "op10_embedding_dedup": embedding_dedup.SQL, "op11_search": lexical_search.SQL}
