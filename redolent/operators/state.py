"""State over event logs: sessions, rate limits, job status, retention, in batch form (the streaming twins are in streaming/)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", ttl: str = "3600 seconds") -> DataFrame:
    """(user, session_start, session_end, events): a session ends when nothing came for the ttl. Map-side merged windows."""
    by = events.where(F.col(ts).isNotNull()).groupBy(user, F.session_window(ts, ttl).alias("w")).agg(F.count("*").alias("events"))
    return by.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def live_sessions(events: DataFrame, now: str, ttl_seconds: int = 3600, capacity: int = 1000) -> DataFrame:
    """The sessions that are kept at a moment: idle less than the ttl, and the most recently seen up to the capacity."""
    last = events.where(F.col("ts") <= F.lit(now).cast("timestamp")).groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count("*").alias("events"))
    fresh = last.where(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp")) < ttl_seconds * 1_000_000)
    return fresh.orderBy(F.col("last_seen").desc(), "user_id").limit(capacity)


def rate_limited(events: DataFrame, limit: int, window: str = "60 seconds", actor: str = "user_id", scope: str = "event_type") -> DataFrame:
    """(scope, actor hash, window start, requests, rejected): requests beyond the limit in each fixed window.

    Counted, not ranked: a hot actor costs one row a window and task."""
    hashed = F.sha2(F.col(actor).cast("string"), 256)
    by = events.where("ts IS NOT NULL").groupBy(F.col(scope).alias("scope"), hashed.alias("actor"), F.window("ts", window)["start"].alias("start")).agg(F.count("*").alias("requests"))
    return by.withColumn("rejected", F.greatest(F.lit(0).cast("long"), F.col("requests") - limit))


def last_status(events: DataFrame, job: str = "user_id", status: str = "event_type", ts: str = "ts") -> DataFrame:
    """(job, status, updated_at): the last status of each job."""
    return events.groupBy(job).agg(F.max_by(status, F.struct(ts, "event_id")).alias("status"), F.max(ts).alias("updated_at"))


def overlapping(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end, jobs): unions of overlapping intervals of a key (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.coalesce(F.col(start) > before, F.lit(True)), 1).otherwise(0)).over(w)
    return intervals.withColumn("_i", island).groupBy(key, "_i").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("jobs")).drop("_i")


def retained(events: DataFrame, key: str, keep: int, *order) -> DataFrame:
    """The last `keep` rows of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("rank", rank).where(F.col("rank") <= keep)


def inherited(turns: DataFrame, session: str, order: list[str], fields: list[str]) -> DataFrame:
    """Every turn with the last known value of each field, its own first."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumns({f"{f}_now": F.last(f, ignorenulls=True).over(w) for f in fields})
