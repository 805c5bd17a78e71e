"""Structured Streaming extensions: live reports over scored rows, and event windows.

The batch operators have no streaming counterpart to match; these are additions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom import schemas as S


def scored_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Scored rows as their JSON-lines files arrive, each (tag, id, lv) once within two days of its arrival."""
    rows = spark.readStream.schema("tag string, received_at timestamp, " + S.SCORED).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return rows.withWatermark("received_at", "2 days").dropDuplicatesWithinWatermark(["tag", "id", "lv"])


def refresh(stream: DataFrame, table: str, checkpoint: str, report: Callable[[DataFrame], DataFrame], sink: str) -> StreamingQuery:
    """Appends each micro-batch to the parquet folder `table` once (by batch number) and rewrites the report over it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)
        report(batch.sparkSession.read.parquet(table).drop("batch")).write.mode("overwrite").parquet(sink)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 day", late: str = "6 hours") -> DataFrame:
    """Counts and mean value by window and type; events later than `late` are dropped on a stream."""
    return _marked(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "6 hours") -> DataFrame:
    return _marked(events, late).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "6 hours") -> DataFrame:
    """Runs of a user's events no more than `gap` apart."""
    return _marked(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _marked(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
