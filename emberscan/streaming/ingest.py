"""Continuous ingest: landed files, time gate, exact dedup, windowed aggregates."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import ts
from ..session import shared_dir

TRIGGER = "45 seconds"


def landed_parquet(spark: SparkSession, path: str, schema, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def landed_payloads(spark: SparkSession, path: str, files_per_trigger: int | None = None, per_line: bool = False) -> DataFrame:
    """Text files with one payload per file, or per line; feed them to the payload transforms."""
    r = spark.readStream.option("wholetext", str(not per_line).lower())
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.text(path).withColumnRenamed("value", "payload")


def gate(mentions: DataFrame, now: datetime | None = None, future_seconds: int = 300, max_age_seconds: int = 7 * 86400) -> DataFrame:
    """``verdict`` per mention. Without ``now`` the trigger's clock is used."""
    t = F.col("published_at")
    if now is None:
        hi = F.current_timestamp() + F.make_dt_interval(secs=F.lit(future_seconds))
        lo = F.current_timestamp() - F.make_dt_interval(secs=F.lit(max_age_seconds))
    else:
        hi, lo = ts(now, future_seconds, "timestamp"), ts(now, -max_age_seconds, "timestamp")
    verdict = F.when(t.isNull(), "unparsable").when(t > hi, "future").when(t < lo, "too_old").otherwise("accepted")
    return mentions.withColumn("verdict", verdict)


def dedup(mentions: DataFrame, keys: list[str], ttl: str = "7 days") -> DataFrame:
    """First sight of a key within the TTL. State is dropped behind the watermark."""
    return mentions.withWatermark("published_at", ttl).dropDuplicatesWithinWatermark(keys)


def tumbling(mentions: DataFrame, width: str, lateness: str = "1 hour") -> DataFrame:
    """Continuous aggregate by (window, trend, source).

    Exact distinct authors need unbounded state; the stream keeps a sketch that
    merges with those of other windows.
    """
    return mentions.withWatermark("published_at", lateness).groupBy(F.window("published_at", width), "trend_id", "source").agg(
        F.count("*").alias("mention_count"), F.avg("sentiment").alias("avg_sentiment"), F.sum(F.coalesce("reach", F.lit(0))).alias("total_reach"),
        F.approx_count_distinct("author_id").alias("authors_estimate")).select(F.col("window.start").alias("bucket"), "trend_id", "source", "mention_count",
                                                                                "avg_sentiment", "total_reach", "authors_estimate")


def sliding_velocity(mentions: DataFrame, width: str, step: str, lateness: str = "1 hour") -> DataFrame:
    """Mentions per (window, trend) over sliding windows."""
    return mentions.withWatermark("published_at", lateness).groupBy(F.window("published_at", width, step), "trend_id").agg(F.count("*").alias("mentions")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "trend_id", "mentions")


def quiet_sessions(mentions: DataFrame, key: str, gap: str = "24 hours", lateness: str = "1 hour") -> DataFrame:
    """Sessions per key, closed by a quiet gap."""
    return mentions.withWatermark("published_at", lateness).groupBy(F.session_window("published_at", gap), key).agg(
        F.count("*").alias("mentions"), F.max("published_at").alias("last_at")).select(F.col("session_window.start").alias("start"), "last_at", key, "mentions")


def run_to_table(stream: DataFrame, mode: str = "append", available_now: bool = True, path: str | None = None) -> DataFrame:
    """Run a stream over all landed files and return its output table.

    ``append`` writes Parquet. ``update`` and ``complete`` rows are appended per
    trigger with their batch number; readers take the last row per key.
    """
    spark = stream.sparkSession
    base = path or f"{shared_dir(spark)}/s-{uuid.uuid4().hex}"
    w = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").outputMode(mode)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=TRIGGER)
    if mode == "append":
        q = w.format("parquet").option("path", f"{base}/out").start()
    else:
        q = w.foreachBatch(_keep_batch(f"{base}/out")).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    return spark.read.schema(stream.schema.add("batch_id", "long")).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def _keep_batch(path: str) -> Callable[[DataFrame, int], None]:
    # A batch that is repeated after a failure replaces its own folder.
    def write(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/b{batch_id}")

    return write


def last_per_key(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Final state of an update-mode stream: the last row of every key."""
    cols = [c for c in updates.columns if c not in keys and c != "batch_id"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols])


def split_batches(accepted_path: str, rejected_path: str, listeners: list[Callable[[DataFrame, int], None]] = ()) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: accepted rows, rejected rows by reason, then listeners.

    A listener that fails is reported and does not stop the others or the ingest.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        df.persist()
        try:
            df.where("verdict = 'accepted'").drop("verdict").write.mode("overwrite").parquet(f"{accepted_path}/b{batch_id}")
            df.where("verdict <> 'accepted'").write.mode("overwrite").parquet(f"{rejected_path}/b{batch_id}")
            for fn in listeners:
                try:
                    fn(df, batch_id)
                except Exception as err:  # noqa: BLE001 - one listener must not stop the rest
                    print(f"listener {getattr(fn, '__name__', fn)} failed on batch {batch_id}: {err}")
        finally:
            df.unpersist()

    return write
