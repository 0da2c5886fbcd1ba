"""Sliding sessions: active rows, refreshes near their end, and sessions of an event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active(sessions: DataFrame, as_of: Column) -> DataFrame:
    return sessions.where(F.col("revoked_at").isNull() & (F.col("expires_at") > as_of))


def refreshed(sessions: DataFrame, as_of: Column, idle_seconds: int, threshold_seconds: int) -> DataFrame:
    """Extends active sessions that are within the threshold of their end, and adds extended."""
    left = F.unix_timestamp("expires_at") - F.unix_timestamp(as_of)
    near = F.coalesce(F.col("revoked_at").isNull() & (left > 0) & (left <= threshold_seconds), F.lit(False))
    until = (F.unix_timestamp(as_of) + idle_seconds).cast("timestamp")
    return sessions.withColumn("extended", near).withColumn("expires_at", F.when(near, until).otherwise(F.col("expires_at")))


def opened(sessions: DataFrame, new: DataFrame, as_of: Column, idle_seconds: int) -> DataFrame:
    """Sessions with new ones (id, user_id), which end after the idle time; an id that stands is not opened again."""
    until = (F.unix_timestamp(as_of) + idle_seconds).cast("timestamp")
    fresh = new.select("id", "user_id").dropDuplicates(["id"]).join(sessions.select("id"), "id", "left_anti")
    rows = fresh.select("id", "user_id", as_of.alias("created_at"), until.alias("expires_at"), F.lit(None).cast("timestamp").alias("revoked_at"))
    return sessions.unionByName(rows.select(*sessions.columns))


def revoked(sessions: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Sessions after some are revoked; those that were before keep their time."""
    asked = sessions.join(ids.select("id").distinct().withColumn("__asked", F.lit(True)), "id", "left")
    return asked.withColumn("revoked_at", F.when(F.col("__asked"), F.coalesce("revoked_at", as_of)).otherwise(F.col("revoked_at"))).select(*sessions.columns)


def sessionised(events: DataFrame, user: str, at: str, idle: str, lateness: str) -> DataFrame:
    """Sessions of a stream by gaps of inactivity; what comes later than the watermark is dropped."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    return timed.groupBy(user, F.session_window(at, idle).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
