"""Incremental ingestion. The same functions run on streams and on batches.

A checkpoint holds the state; give a shared folder. Batches are written under their id, so that a batch that is tried again replaces
what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; a pattern may name one file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def retry_step(status: DataFrame) -> DataFrame:
    """next_step and retry: scanned files go to the next parser, retryable ones again to the same, others end."""
    return status.withColumns({
        "next_step": F.when(F.col("status") == "scanned", F.col("processing_step") + 1).when(F.col("status") == "retryable", F.col("processing_step")),
        "retry": F.col("status").isin("scanned", "retryable"),
    })


def first_of_each(events: DataFrame, key: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """One row for each key; in a stream, state is held for `delay`."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def first_ever(events: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key of all time. In a stream the keys are its state, so a batch costs what it holds, however much was ingested before."""
    return events.dropDuplicates(key)


def sums(events: DataFrame, key: str, value: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.round(F.col(value) * 100).cast("long")).alias("cents"))


def windowed(events: DataFrame, time: str, key: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: counts in tumbling windows of event time."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), key).count()


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """All that is there now, then stops. A cluster job passes a processing-time trigger instead."""
    q = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def append_new(batch: DataFrame, batch_id: int, target: str, key: list[str]) -> None:
    """Idempotent sink for targets that others write to as well: rows whose keys the target has from other batches are left out, and the batch has its own folder. Each batch reads the target's keys; `first_ever` does not."""
    spark = batch.sparkSession
    rows = batch.dropDuplicates(key)
    try:
        seen = spark.read.option("basePath", target).parquet(f"{target}/batch=*").where(F.col("batch") != batch_id).select(*key)
        rows = rows.join(seen, key, "left_anti")
    except Exception as e:  # nothing is written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
