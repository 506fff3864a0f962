"""Queue building and queue runs as Structured Streaming micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thoughtloom.operators.dedupe import DEFAULT_THRESHOLD
from thoughtloom.operators.dedupe_index import filter_batch
from thoughtloom.operators.queue import chosen_entries, new_entries
from thoughtloom.schemas import QUEUE


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Entries written so far (at least one micro-batch must have run)."""
    stored = spark.read.schema(f"{QUEUE}, batch bigint").option("basePath", path).parquet(path)
    return stored.drop("batch")


def start_queue(
    fragments: DataFrame,
    path: str,
    checkpoint: str,
    *,
    now: Callable[[], Column] = F.current_timestamp,
    order: str = "scan_order",
    index: str | None = None,
    threshold: float = DEFAULT_THRESHOLD,
    scope: str | None = None,
) -> StreamingQuery:
    """Append unseen fragments of a stream to the queue table under ``path``.

    With a folder ``index``, near duplicates of fragments that earlier micro-batches or
    the same one kept are left out; what was kept is stored there (``dedupe_index``).

    Each micro-batch writes its own folder with overwrite, so a batch that is
    replayed after a failure replaces itself instead of adding rows, and ids
    queued by earlier batches are left out by an anti join.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = spark.createDataFrame([], QUEUE)
        if batch_id > 0:
            stored = spark.read.schema(f"{QUEUE}, batch bigint").option("basePath", path).parquet(path)
            earlier = stored.where(F.col("batch") < batch_id).drop("batch")
        if index:
            judged = filter_batch(batch, batch_id, index, "text", order, threshold, scope=scope)
            fresh = chosen_entries(earlier, batch, judged.where("keep").select("id", order), now(), order)
        else:
            fresh = new_entries(earlier, batch, now(), order)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        fragments.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
