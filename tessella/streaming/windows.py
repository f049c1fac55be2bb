"""Structured Streaming over an event table: windows, sessions, deduplication and late rows.

An extension beyond batch evaluation. Each job reads a folder of Parquet files with `availableNow` and writes every
micro-batch to the shared folder: in complete mode the newest batch is the result, in append mode all of them are. Batches
overwrite their own folder, so a repeated batch after a failure leaves no row twice.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import shared_path, table


def events_stream(spark: SparkSession, d: str, delay: str | None) -> DataFrame:
    """The events as a stream with event time in the session's zone."""
    schema = table(spark, d, "events").schema
    path = f"{d}/events.parquet"
    source = spark.readStream.schema(schema).parquet(path) if os.path.isdir(path) else spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    s = source.withColumn("ts", F.col("ts").cast("timestamp"))
    return s.withWatermark("ts", delay) if delay else s


def run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and returns its result."""
    place, out = shared_path(spark, "state"), shared_path(spark, "stream")
    batches: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        batches.append(number)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    wanted = [max(batches)] if mode == "complete" else sorted(set(batches))
    return spark.read.schema(stream.schema).parquet(*[f"{out}/batch={n}" for n in wanted])


def daily(s: DataFrame) -> DataFrame:
    w = s.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def sliding(s: DataFrame) -> DataFrame:
    w = s.groupBy(F.window("ts", "1 day", "12 hours")).agg(F.count("*").alias("n"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("start"), "n")


def sessions(s: DataFrame) -> DataFrame:
    w = s.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def deduplicated(s: DataFrame) -> DataFrame:
    return s.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")


def late(s: DataFrame) -> DataFrame:
    """Hourly counts with a watermark of an hour: a window is written once the watermark has passed it, and rows behind the watermark are dropped."""
    w = s.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("start"), "n")


def job(build: Callable[[DataFrame], DataFrame], mode: str, delay: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: run(spark, build(events_stream(spark, d, delay)), mode)


st1_tumbling = job(daily, "complete")
st2_sliding = job(sliding, "complete")
st3_session = job(sessions, "complete")
st4_dedupe = job(deduplicated, "append", "1 hour")
st5_late = job(late, "append", "1 hour")
