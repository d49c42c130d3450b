"""A folder watched as a stream: each batch of arrivals triggers one incremental sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.settings import Settings
from ..plans.sync import Store, sync
from ..sources import files


def watch(spark: SparkSession, source: str, store: Store, checkpoint: str, settings: Settings | None = None, once: bool = True) -> StreamingQuery:
    """Starts the watch; ``once`` takes what is there and stops.

    The stream only tells that something arrived; what changed is decided by content hash,
    so a batch that is delivered twice changes nothing.
    """
    arrivals = files.raw_files(spark, source, streaming=True).select("doc_id", "modificationTime")

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sync(spark, source, store, settings)

    writer = arrivals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def windowed_latency(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, event_type, n, total) of an event stream or table (ts, event_type, value); late rows beyond ``late`` are dropped."""
    from pyspark.sql import functions as F

    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("window"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
