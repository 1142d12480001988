"""Trend counts per time window and type on a stream, with a watermark.

State is bounded by the watermark: a window's state is dropped once the
watermark passes its end, and rows later than the watermark are ignored.
The query runs in *update* mode through ``foreachBatch``; ``windows.WindowTable``
takes up the changed windows of every micro-batch, replay-safe and with a
bounded number of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .windows import WindowTable

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, landing_dir: str, max_files: int = 16,
                 schema: str = EVENT_SCHEMA) -> DataFrame:
    """Events as they land, as files or as folders of files
    (``events*.parquet``); nothing need be there yet."""
    return (spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", max_files)
            .parquet(f"{landing_dir.rstrip('/')}/events*.parquet"))


def trend_counts(events: DataFrame, window: str = "1 day", watermark: str = "1 hour",
                 key: str = "event_type", ts: str = "ts") -> DataFrame:
    """Counts per (window, key).  Watermarks need a TIMESTAMP; a
    TIMESTAMP_NTZ event time is turned into the instant with the same UTC
    wall clock, so day windows start at the NTZ midnights whatever the
    session time zone is."""
    if events.schema[ts].dataType.typeName() == "timestamp_ntz":
        c = F.col(ts)
        events = events.withColumn(ts, F.make_timestamp(
            F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
            F.expr(f"extract(SECOND FROM `{ts}`)"), F.lit("UTC")))
    return (events.withWatermark(ts, watermark)
            .groupBy(F.window(ts, window), key)
            .agg(F.count(F.lit(1)).alias("count")))


def latest_windows(spark: SparkSession, out: str, key: str = "event_type") -> DataFrame:
    """Counts where every batch wrote its changed windows to a folder
    ``batch_id=N`` of its own."""
    return (spark.read.parquet(out)
            .groupBy("window_start", "window_end", key)
            .agg(F.max_by("count", "batch_id").alias("count")))


def run_trend_stream(spark: SparkSession, landing_dir: str, out: str | None = None,
                     window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    out = out or scratch_path(spark, "stream-trend")

    session_tz = spark.conf.get("spark.sql.session.timeZone")

    def utc_wall_clock(col: str):
        return F.convert_timezone(F.lit(session_tz), F.lit("UTC"), F.col(col).cast("timestamp_ntz"))

    table = WindowTable(spark, out, "event_type", watermark)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        table.add(batch.select(utc_wall_clock("window.start").alias("window_start"),
                               utc_wall_clock("window.end").alias("window_end"),
                               "event_type", "count"), batch_id)

    q = (trend_counts(event_stream(spark, landing_dir), window, watermark).writeStream
         .outputMode("update")
         .foreachBatch(write_batch)
         .option("checkpointLocation", out + "_checkpoint")
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    counts = table.read()
    if counts is None:  # nothing has landed yet
        return spark.createDataFrame([], "window_start timestamp_ntz, window_end timestamp_ntz, event_type string, count long")
    return counts
