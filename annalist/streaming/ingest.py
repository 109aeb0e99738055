"""Continuous ingest of events, and event-time windows over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annalist.operators import store


def follow_log(spark: SparkSession, arrivals: str, log: str, checkpoint: str, schema) -> StreamingQuery:
    """Append every batch of new files in ``arrivals`` to the log at ``log``, then stop.

    Batches are upserts by id, so a batch that is run again after a failure changes nothing; late events go to the month
    of their own stamp, and the graph is folded from the log, so their arrival order never shows in it.
    """
    source = spark.readStream.schema(schema).parquet(arrivals)

    def upsert(batch: DataFrame, _: int) -> None:
        clean = store.event_log(batch)
        if clean.limit(1).count():
            store.append(clean, log)

    return source.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, at: str, keys: list[str], width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts per window of event time; rows later than ``late`` behind the newest are left out in a stream."""
    d = events.withWatermark(at, late) if events.isStreaming else events
    w = F.window(F.col(at), width, slide) if slide else F.window(F.col(at), width)
    return d.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("from_"), F.col("w.end").alias("until_"), *keys, "n")


def sessions(events: DataFrame, at: str, keys: list[str], gap: str, late: str = "1 day") -> DataFrame:
    """Sessions of a key: its events without a pause longer than ``gap``."""
    d = events.withWatermark(at, late) if events.isStreaming else events
    return d.groupBy(F.session_window(F.col(at), gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("from_"), F.col("w.end").alias("until_"), *keys, "n")
