"""Structured Streaming form of the user × day event panel.

The batch ``events_daily`` pre-aggregates raw events to (user, day) before
any window work. For continuously arriving event files the same aggregate
is a watermarked, windowed streaming aggregation: state is one row per
(user, day) until the watermark passes the day, then the final row is
appended. The downstream cleaning operators run on the appended table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def events_daily_stream(spark: SparkSession, source_dir: str, glob: str = "events*.parquet", lateness: str = "1 day") -> DataFrame:
    """Streaming (user, day) aggregate: n_events, value, avg_value."""
    ev = (
        spark.readStream.schema(EVENT_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", 16)
        .parquet(source_dir)
        .select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    )
    daily = (
        ev.withWatermark("ts", lateness)
        .groupBy("user_id", F.window("ts", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value"), F.avg("value").alias("avg_value"))
    )
    return daily.select("user_id", F.to_date("w.start").alias("day"), "n_events", "value", "avg_value")


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append every closed day to a parquet folder until the input is drained."""
    q = (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_open_days(spark: SparkSession, closed: DataFrame, source_dir: str, glob: str = "events*.parquet") -> DataFrame:
    """The closed days plus the days the watermark still holds open.

    A day closes only when a later event arrives; at the end of a finite input
    the last days are taken from the events after the last closed day.
    """
    ev = spark.read.schema(EVENT_SCHEMA).option("pathGlobFilter", glob).parquet(source_dir)
    last = closed.agg(F.max("day")).scalar()
    day = F.to_date(F.col("ts").cast("timestamp"))
    tail = (
        ev.where(day > F.coalesce(last, F.lit("0001-01-01").cast("date")))
        .groupBy("user_id", day.alias("day"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value"), F.avg("value").alias("avg_value"))
    )
    return closed.unionByName(tail)
