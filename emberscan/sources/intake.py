"""Intake: time gate, bulk posts, invariants, merging of sources."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import text as tx
from ..functions.times import ts

# One schema for every source.
MENTION_COLUMNS = ["content_hash", "source", "external_id", "author_id", "author_handle", "text", "language", "published_at", "url", "has_media"]


def event_time_gate(rows: DataFrame, raw: str, now: datetime, future_seconds: int = 300, max_age_seconds: int = 7 * 86400) -> DataFrame:
    """``published_at`` parsed from ``raw`` and a ``verdict``: accepted or the reason."""
    t = F.col(raw).try_cast("timestamp_ntz")
    verdict = (F.when(t.isNull(), "unparsable").when(t > ts(now, future_seconds), "future")
               .when(t < ts(now, -max_age_seconds), "too_old").otherwise("accepted"))
    return rows.withColumns({"published_at": t, "verdict": verdict})


def bulk_intake(rows: DataFrame, now: datetime, min_chars: int = 5) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of a bulk upload in the unified shape.

    Missing fields get defaults. Rejected rows keep their reason.
    """
    reason = (F.when(~F.coalesce(F.col("source").isin(params.SOURCES), F.lit(False)), "unknown_source")
              .when(F.length(F.coalesce("text", F.lit(""))) < min_chars, "short_text")
              .when(F.coalesce(F.col("external_id").cast("string"), F.lit("")) == "", "no_external_id"))
    filled = rows.withColumns({
        "reject_reason": reason, "author_id": F.coalesce("author_id", F.lit("unknown")), "language": F.coalesce("language", F.lit("und")),
        "published_at": F.coalesce("published_at", ts(now)), "content_hash": tx.content_hash(F.col("external_id"), F.col("text")),
    })
    return filled.where("reject_reason is null").drop("reject_reason"), filled.where("reject_reason is not null")


def check_invariants(rows: DataFrame, now: datetime, skew_seconds: int = 60) -> DataFrame:
    """Named checks per row and ``valid``: id, time order, content, language."""
    checks = {
        "ok_id": F.col("id") == tx.mention_id(F.col("source"), F.col("external_id")),
        "ok_time": (F.col("published_at") <= F.col("fetched_at")) & (F.col("fetched_at") <= ts(now, skew_seconds)),
        "ok_content": F.length(F.trim(F.coalesce("text", F.lit("")))) > 0,
        "ok_language": F.col("language").isNotNull(),
    }
    out = rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in checks.items()})
    return out.withColumn("valid", reduce(lambda a, b: a & b, [F.col(k) for k in checks]))


def merge_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of per-source frames by column name; missing columns become NULL."""
    frames = [df for df in parts.values() if df is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
