"""Structured Streaming faces of session state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, event_type and n of an event stream (or table): ts, event_type. Events later than the watermark are left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def active_states(log: DataFrame) -> DataFrame:
    """session_id and active (sorted, joined) after all of a log (session_id, seq, op: add or remove, state): of each state the last operation counts."""
    last = log.groupBy("session_id", "state").agg(F.max_by("op", "seq").alias("op"))
    return last.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("op") == "add", F.col("state")))), ",").alias("active"))
