"""Aggregates over event time; each works on a static table and on a stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", schema: str = EVENTS, per_trigger: int = 16) -> DataFrame:
    """New files of a folder as a stream, with event time as a timestamp in UTC."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def at_utc(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def counted(events: DataFrame, window: Column, by: list[str], late: str | None = None) -> DataFrame:
    """Events, distinct-free sums and extremes in each window and group; ``late`` sets a watermark."""
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("most"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total", "most")


def tumbling(events: DataFrame, size: str, by: list[str], late: str | None = None) -> DataFrame:
    return counted(events, F.window("ts", size), by, late)


def sliding(events: DataFrame, size: str, step: str, by: list[str], late: str | None = None) -> DataFrame:
    return counted(events, F.window("ts", size, step), by, late)


def sessions(events: DataFrame, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    return counted(events, F.session_window("ts", gap), by, late)


def usage_counters(events: DataFrame, by: list[str]) -> DataFrame:
    """Running counters, to be written in update or complete mode."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("value"))


def upsert_batches(stream: DataFrame, read, write, upsert, checkpoint: str) -> StreamingQuery:
    """Each batch written over a snapshot: ``write(upsert(read(), batch))``, all at hand, then stop. Batches are replayed whole after a failure, and an upsert twice is an upsert once."""

    def step(batch: DataFrame, _: int) -> None:
        write(upsert(read(), batch))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_of(query: StreamingQuery) -> list[dict]:
    """What the query reported so far: batch, rows in, duration."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": p["batchDuration"]} for p in query.recentProgress]
