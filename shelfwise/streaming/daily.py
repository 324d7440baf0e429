"""68. stream_daily_sales: daily totals per key from a sales-event stream.

Event-time tumbling windows of one day with a watermark; rows later than the
watermark are dropped by Spark. In append mode a day is emitted once the watermark
passes its end, so the last ``delay`` of the stream stays open: the batch twin of
this query keeps only days whose end is at or before ``max(ts) - delay``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import scratch_path


def event_instant(c: F.Column, dtype: str) -> F.Column:
    """Event time as a TIMESTAMP instant. A zone-less (NTZ) wall clock is read as UTC
    whatever the session time zone (watermarks need TIMESTAMP, and a plain cast would
    read the wall clock in the session zone and shift the day windows)."""
    if dtype != "timestamp_ntz":
        return c.cast("timestamp")
    micros = F.unix_timestamp(c) * 1_000_000 + F.date_format(c, "SSSSSS").cast("bigint")
    return F.timestamp_micros(micros)


def utc_day(c: F.Column) -> F.Column:
    """Calendar day (UTC) of an instant, independent of the session time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(c) / 86400).cast("int"))


def stream_daily_sales(events: DataFrame, delay: str = "1 day", key: str = "user_id",
                       value: str = "value", sale_types=("purchase",), ts: str = "ts") -> DataFrame:
    """Streaming (or batch) frame of events -> (day, key, n_events, total_value)."""
    t = event_instant(F.col(ts), events.schema[ts].dataType.simpleString())
    ev = (events.where(F.col("event_type").isin(list(sale_types)))
          .select(t.alias("ts"), key, value))
    agg = (ev.withWatermark("ts", delay)
           .groupBy(F.window("ts", "1 day"), key)
           .agg(F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("total_value")))
    return agg.select(utc_day(F.col("window.start")).alias("day"), key, "n_events", "total_value")


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """File stream over the events table (schema taken from the table, not inferred)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern that only this name matches: it may be one file or a folder of part files
    return spark.readStream.schema(schema).parquet(path[:-1] + "[t]")


def run_to_table(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> str:
    """Run a streaming frame to completion (availableNow) into a parquet folder under the
    shared checkpoint folder; the file sink is exactly-once through its checkpoint."""
    out = scratch_path(spark, name)
    q = (df.writeStream.format("parquet").outputMode(mode)
         .option("path", out + "/data").option("checkpointLocation", out + "/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out + "/data"


def run_daily_sales(spark: SparkSession, sf_dir: str, delay: str = "1 day") -> DataFrame:
    out = run_to_table(spark, stream_daily_sales(event_stream(spark, sf_dir), delay), "stream_daily")
    res = spark.read.schema("day date, user_id bigint, n_events bigint, total_value double").parquet(out)
    return res.select("day", "user_id", "n_events", F.round("total_value", 6).alias("total_value"))
