"""Event streams: idempotent delivery, daily change counts, sliding load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgetrail import dims
from lodgetrail.session import new_work_dir

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Landed event files; times become instants because watermarks need them."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def delivered_once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once, remembered for the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def daily_changes(events: DataFrame, delay: str = "1 hour", offset: str = "17 hours") -> DataFrame:
    """Distinct listings per change type and local day, once the day has closed.

    Local midnight is 17:00 UTC. The first stage lets one row through per
    (day, type, listing) and the second counts those, so the count is exact and
    its state is a number per day and type.
    """
    day = F.window("ts", "1 day", "1 day", offset)
    firsts = (
        events.withWatermark("ts", delay)
        .groupBy(day.alias("day"), "event_type", "user_id").agg(F.count(F.lit(1)).alias("rows"))
    )
    return firsts.groupBy(F.window(F.window_time("day"), "1 day", "1 day", offset).alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("listings"), F.sum("rows").alias("rows"))


def sliding_load(events: DataFrame, length: str = "60 seconds", step: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Requests per client in overlapping windows."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", length, step).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("requests"))
    )


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything landed so far and return its output as a table."""
    spark = stream.sparkSession
    out, checkpoint = new_work_dir(spark, label), new_work_dir(spark, f"{label}-checkpoint")
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
