"""Keyword rows as a stream: repeats dropped inside a watermark, rolling demand per window, merged batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def distinct_rows(rows: DataFrame, event_time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Rows without repeats of the same keyword, market and source; state is bounded by the watermark."""
    keyed = rows.withColumn("join_key", T.join_key(F.col("keyword")))
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["market", "join_key", "src"])


def demand(rows: DataFrame, event_time: str = "ts", width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Keywords and volume per market and window of event time."""
    return rows.withWatermark(event_time, delay).groupBy(F.window(event_time, width), "market").agg(
        F.count("*").alias("keywords"), F.sum("volume").alias("volume"),
    )


def into(rows: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame], DataFrame]):
    """Write each micro-batch, merged by ``merge``, as one folder a batch; a repeated batch overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        merge(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
