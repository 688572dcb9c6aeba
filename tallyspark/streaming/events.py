"""Event streams: repeated events are dropped within a watermark, and windows are aggregated as data comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh_events(stream: DataFrame, time: str = "ts", key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """The stream without repeated keys; state is kept for as long as events may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, dims: list[str], value: str, time: str = "ts", length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, window_end, *dims, n, total) of tumbling or sliding windows."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = stream.withWatermark(time, late).groupBy(w, *dims).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *dims, "n", "total")


def sessions(stream: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user, started, ended, events) of sessions that a gap ends."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("events"))
    return out.select(user, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def to_parquet(stream: DataFrame, folder: str, checkpoint: str):
    """Starts writing finished rows as files, each exactly once, until all that is there now is done."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
