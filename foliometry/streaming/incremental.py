"""Scoring of page rows as files arrive, against a frozen profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from foliometry.functions.scalar import band_loss


def score_arrivals(spark: SparkSession, source: str, schema: T.StructType, block: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...] = ("role", "dim"), ids: tuple[str, ...] = ("paper", "page", "dim")) -> StreamingQuery:
    """Long page rows (ids, keys, value) from new files under `source` to losses appended under `out`.

    The block is a fixed table that joins each batch. The checkpoint remembers which files are done, so a restart repeats
    nothing; rows of one batch that repeat an id count once.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(list(ids)).join(block.select(*keys, "scale", "lo", "hi"), list(keys))
        loss = band_loss(F.col("value"), F.col("lo"), F.col("hi"), F.col("scale"))
        rows.select(*ids, loss.alias("loss")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
