"""Activation kept up to date from an event stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thoughtloom.operators.activation import replay


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """(key, activation) after the last micro-batch."""
    states = spark.read.option("basePath", path).parquet(path)
    newest = states.select(F.max("version")).scalar()
    return states.where(F.col("version") == newest).drop("version")


def start_activation(
    events: DataFrame,
    path: str,
    checkpoint: str,
    order: Sequence[str],
    *,
    start: float,
    event_id: str = "event_id",
) -> StreamingQuery:
    """Fold (key, order..., step) events of a watermarked stream into versions.

    A touch is not idempotent, so repeated events are removed by id within the
    watermark, and each micro-batch derives version ``n`` from version
    ``n - 1`` into its own folder: replaying a batch rewrites the same state.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = batch.select("key").distinct().withColumn("activation", F.lit(start))
        if batch_id > 0:
            known = spark.read.parquet(f"{path}/version={batch_id - 1}")
            seen = known.unionByName(seen.join(known.select("key"), "key", "left_anti"))
        replay(seen, batch, order).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return (
        events.dropDuplicatesWithinWatermark([event_id])
        .writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
