"""Structured Streaming on the events table: bars and sessions with watermarks, and idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def timed(events: DataFrame) -> DataFrame:
    """Events with a time that watermarks accept."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events files of a folder as a stream."""
    return timed(spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").parquet(folder))


def tumbling_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """symbol, start, open, high, low, close, volume per window; the same for a stream and for a table."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    key = F.struct("ts", "event_id")
    return events.groupBy(F.window("ts", width), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    ).select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, end, n, total of runs of events no further apart than the gap."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    out = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def append_once(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """A query that appends each batch's rows whose keys the table at path lacks; a repeated batch adds nothing."""
    from ..operators.logs import fresh_rows

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        log = spark.createDataFrame([], batch.schema)
        try:
            log = spark.read.schema(batch.schema).parquet(path)
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error):
                raise
        fresh_rows(log.select(*keys), batch, keys).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
