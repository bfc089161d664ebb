"""Event log: filter, append, replay, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Types of events in the log.
EVENT_TYPES = ["scan.tick", "trend.upserted", "trend.velocity_spike", "trend.phase_changed", "engine.status_changed", "engine.log_appended",
               "alert.triggered", "alert.acknowledged", "briefing.generated", "report.updated", "connection.heartbeat"]


def filter_events(events: DataFrame, types=None, topics=None, since=None, type_col="type", topic_col="topic", ts_col="ts") -> DataFrame:
    """Keep events of the given types and topics after ``since``. Works on streams."""
    if types:
        events = events.where(F.col(type_col).isin(*types))
    if topics:
        events = events.where(F.col(topic_col).isin(*topics))
    return events if since is None else events.where(F.col(ts_col) > since)


def with_event_id(events: DataFrame, order: list[str]) -> DataFrame:
    """Monotonic ids ``ms-seq``: the millisecond and the position inside it."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("ts_ms").orderBy(*order)
    return events.withColumn("ts_ms", ms).withColumn("seq", F.row_number().over(w)).withColumn(
        "event_id", F.concat_ws("-", F.col("ts_ms").cast("string"), F.col("seq").cast("string")))


def replay(log: DataFrame, last_ms: int, last_seq: int, retained: int = 1000, best_effort: int = 50) -> DataFrame:
    """Events after a given id with ``needs_resync``.

    Only the newest ``retained`` events are served. If the id is no longer among
    them the newest ``best_effort`` are returned and flagged.
    """
    tail = log.orderBy(F.desc("ts_ms"), F.desc("seq")).limit(retained)
    known = F.max(((F.col("ts_ms") == last_ms) & (F.col("seq") == last_seq)).cast("int")).over(Window.partitionBy(F.lit(1))) == 1
    pos = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("ts_ms"), F.desc("seq")))
    t = tail.select("*", known.alias("_known"), pos.alias("_pos"))
    after = (F.col("ts_ms") > last_ms) | ((F.col("ts_ms") == last_ms) & (F.col("seq") > last_seq))
    return t.where(F.when(F.col("_known"), after).otherwise(F.col("_pos") <= best_effort)).withColumn("needs_resync", ~F.col("_known")).drop("_known", "_pos")


def events_per_second(log: DataFrame, now_ms: int) -> DataFrame:
    return log.where((F.col("ts_ms") > now_ms - 1000) & (F.col("ts_ms") <= now_ms)).agg(F.count("*").alias("events_per_second"))
