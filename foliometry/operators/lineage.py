"""Tables in the shared scratch folder, which keep the lineage of iterative operators short."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or else the context's checkpoint folder.

    Where neither is set, a fresh local folder serves if all tasks run in this process; on a cluster that is an error, as
    executors would write where nobody reads.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else getattr(spark, "_foliometry_tables", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark._foliometry_tables = tempfile.mkdtemp(prefix="spark-")
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/foliometry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
