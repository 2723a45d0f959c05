"""Streams: windows over event time, bounded de-duplication, and ingestion in exact batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamplight.schemas import DISCOVERED


def tumbling(events: DataFrame, time: str, size: str, keys: list[str], late: str | None = None, slide: str | None = None) -> DataFrame:
    """(start, stop, keys, n) per window; late events up to the bound still count in a stream."""
    e = events.withWatermark(time, late) if late else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return e.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    e = events.withWatermark(time, late) if late else events
    return e.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n")


def distinct_within(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """First event of each key within the bound; state older than it is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def ingest(spark: SparkSession, landing: str, checkpoint: str, handle: Callable[[DataFrame, int], None], files_per_batch: int = 100) -> StreamingQuery:
    """Listings that land as parquet, handled in batches of bounded size until none is left.

    A batch that was handled but not yet noted is handled again under the same number, so handle
    must write under that number.
    """
    stream = spark.readStream.schema(DISCOVERED).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
