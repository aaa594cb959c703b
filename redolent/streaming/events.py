"""Streaming twins of the state operators: rate limits and sessions over an event stream with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet event files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def rate_limits(events: DataFrame, limit: int, window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """(scope, actor, start, requests, rejected): as state.rate_limited; windows close when the watermark passes them."""
    by = events.withWatermark("ts", late).groupBy(F.col("event_type").alias("scope"), F.sha2(F.col("user_id").cast("string"), 256).alias("actor"), F.window("ts", window).alias("w")).agg(F.count("*").alias("requests"))
    return by.select("scope", "actor", F.col("w.start").alias("start"), "requests", F.greatest(F.lit(0).cast("long"), F.col("requests") - limit).alias("rejected"))


def sessions(events: DataFrame, ttl: str = "3600 seconds", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, events): as state.sessions; a session is given out once nothing can join it."""
    by = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", ttl).alias("w")).agg(F.count("*").alias("events"))
    return by.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process all that is there and stop; the checkpoint makes a restart go on where it ended, each row once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
