"""Time series: buckets, smoothing, baselines, continuous aggregates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.numeric import clamp, js_round, js_round2, ratio
from ..functions.times import age_seconds, bucket, ts, within


def bucket_index(t: Column, now: datetime, window: params.ScoreWindow) -> Column:
    """Index of the bucket that holds ``t``, clamped to 0..K-1."""
    width = window.seconds / window.buckets
    return clamp(F.floor((F.lit(float(window.seconds)) - age_seconds(t, now)) / width), 0, window.buckets - 1)


def in_window(mentions: DataFrame, now: datetime, window: params.ScoreWindow) -> DataFrame:
    t = F.col("published_at")
    return mentions.where(within(t, now, window.seconds) & (t <= ts(now)))


def bucket_counts(mentions: DataFrame, now: datetime, window: params.ScoreWindow) -> DataFrame:
    """Dense ARRAY of K counts per trend. K is fixed, so plain sums suffice."""
    rows = in_window(mentions, now, window).select("trend_id", bucket_index(F.col("published_at"), now, window).alias("b"))
    return rows.groupBy("trend_id").agg(
        F.array(*[F.count_if(F.col("b") == i) for i in range(window.buckets)]).alias("counts"), F.count("*").alias("mentions")
    )


def histogram(mentions: DataFrame, now: datetime, window: params.ScoreWindow) -> DataFrame:
    """One row per (trend, bucket), empty buckets included."""
    return bucket_counts(mentions, now, window).select("trend_id", F.posexplode("counts").alias("bucket", "n"))


def ewma(counts: Column, window: params.ScoreWindow) -> Column:
    """Smoothed rate per hour after the last bucket, starting from zero."""
    a, d = window.alpha, window.bucket_hours
    return F.aggregate(counts, F.lit(0.0), lambda v, c: c / F.lit(d) * a + v * (1 - a))


def ewma_series(counts: Column, window: params.ScoreWindow) -> Column:
    """The smoothed rate after every bucket, as an ARRAY of K values."""
    a, d = window.alpha, window.bucket_hours
    return F.aggregate(
        counts, F.array().cast("array<double>"),
        lambda v, c: F.concat(v, F.array(c / F.lit(d) * a + F.coalesce(F.get(v, F.size(v) - 1), F.lit(0.0)) * (1 - a))),
    )


def variance_pop(values: Column) -> Column:
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n


def daily_baseline(mentions: DataFrame, now: datetime, days: int = 6) -> DataFrame:
    """Median hourly rate of the ``days`` full days before the last 24 hours."""
    day = F.floor(age_seconds(F.col("published_at"), now) / 86400)
    t = F.col("published_at")
    rows = mentions.where(within(t, now, (days + 1) * 86400) & (t <= ts(now))).select("trend_id", day.alias("d"))
    counts = F.array(*[F.count_if(F.col("d") == i) for i in range(1, days + 1)])
    s = F.array_sort(F.col("per_day"))
    lo, hi = (days - 1) // 2, days // 2
    return rows.groupBy("trend_id").agg(counts.alias("per_day")).select(
        "trend_id", ((F.get(s, lo) + F.get(s, hi)) / 2 / 24.0).alias("baseline")
    )


def delta_pct(velocity: Column, baseline: Column, mentions: Column) -> Column:
    """Percent change against the baseline, -999..999; 999 for a new trend with mass."""
    raw = 100 * (velocity - baseline) / F.nullif(baseline, F.lit(0.0))
    return F.when(F.coalesce(baseline, F.lit(0.0)) <= 0, F.when(mentions >= 5, 999).otherwise(0)).otherwise(
        clamp(js_round(raw), -999, 999)
    ).cast("bigint")


def hourly_mentions(mentions: DataFrame, width_seconds: int = 3600, with_trend: bool = True) -> DataFrame:
    """Continuous aggregate by (bucket, trend, source) or (bucket, source)."""
    keys = [bucket(F.col("published_at"), width_seconds).alias("bucket")] + (["trend_id"] if with_trend else []) + ["source"]
    aggs = [F.count("*").alias("mention_count"), F.count_distinct("author_id").alias("unique_authors")]
    if with_trend:
        aggs += [F.avg("sentiment").alias("avg_sentiment"), F.sum(F.coalesce("reach", F.lit(0))).alias("total_reach")]
    return mentions.groupBy(*keys).agg(*aggs)


def trend_scores(mentions: DataFrame, width_seconds: int = 300, full_rate: float = 5.0) -> DataFrame:
    """Score time series: one row per (trend, bucket) with its change in percent.

    The change looks at the previous bucket row; the window runs over bucket rows,
    whose number is set by the clock and not by the traffic of a trend.
    """
    per = mentions.groupBy("trend_id", bucket(F.col("published_at"), width_seconds).alias("bucket_time")).agg(
        F.count("*").alias("mention_count"), F.avg("bot_score").alias("bot"), F.avg("sentiment").alias("avg_sentiment")
    )
    rate = F.col("mention_count") / F.lit(width_seconds / 3600.0)
    w = Window.partitionBy("trend_id").orderBy("bucket_time")
    prev = F.lag("mention_count").over(w)
    return per.select(
        "trend_id", "bucket_time", "mention_count", "avg_sentiment",
        rate.alias("velocity"),
        js_round2(100 * F.least(F.lit(1.0), rate / full_rate) * (1 - F.col("bot"))).alias("score"),
        (100 * (F.col("mention_count") - prev) / F.nullif(prev.cast("double"), F.lit(0.0))).alias("delta_pct"),
    )


def downsample(scores: DataFrame, width_seconds: int) -> DataFrame:
    """Score series at a coarser grain."""
    return scores.groupBy("trend_id", bucket(F.col("bucket_time"), width_seconds).alias("bucket")).agg(
        F.avg("score").alias("avg_score"), F.max("score").alias("max_score"),
        F.sum("mention_count").alias("mentions"), F.avg("delta_pct").alias("avg_delta"))


def source_distribution(hourly: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """Share of each source from the hourly aggregate. The total runs over sources only."""
    per = hourly.where(F.col("bucket") >= ts(now, -hours * 3600)).groupBy("source").agg(
        F.sum("mention_count").alias("mention_count"), F.sum("unique_authors").alias("unique_authors"))
    total = F.sum("mention_count").over(Window.partitionBy(F.lit(1)))
    return per.withColumn("pct", F.round(100.0 * F.col("mention_count") / F.nullif(total, F.lit(0)), 2))


def versus_previous(mentions: DataFrame, now: datetime, seconds: float) -> DataFrame:
    """Current against previous window for all trends in one conditional aggregate."""
    t = F.col("published_at")
    cur = t >= ts(now, -seconds)
    prev = (t >= ts(now, -2 * seconds)) & (t < ts(now, -seconds))
    rows = mentions.where(t >= ts(now, -2 * seconds))
    agg = rows.groupBy("trend_id").agg(
        F.count_if(cur).alias("current"), F.count_if(prev).alias("previous"),
        F.count_distinct(F.when(cur, F.col("author_id"))).alias("unique_authors"),
        F.avg(F.when(cur, F.col("sentiment"))).alias("avg_sentiment"))
    diff = F.col("current") - F.col("previous")
    return agg.withColumns({"change": diff, "change_pct": F.round(ratio(diff, F.col("previous")) * 100, 2)})


def normalised_series(mentions: DataFrame, now: datetime, hours: int, points: int) -> DataFrame:
    """Exactly ``points`` values in 0..1 per trend (min-max over the points)."""
    shape = params.ScoreWindow(hours, points, 0.0, "")
    c = F.col("counts")
    lo, hi = F.array_min(c), F.array_max(c)
    return bucket_counts(mentions, now, shape).select(
        "trend_id", F.posexplode(F.transform(c, lambda x: F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(F.lit(0.0)))).alias("point", "value"))


def sliding_sum(mentions: DataFrame, minutes: int = 60) -> DataFrame:
    """Sliding sum over minute buckets. The window sees minutes, never mentions."""
    minute = F.floor(F.unix_micros(F.col("published_at").cast("timestamp")) / F.lit(60_000_000))
    per = mentions.groupBy("trend_id", minute.alias("minute")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("trend_id").orderBy("minute").rangeBetween(-(minutes - 1), 0)
    return per.select("trend_id", "minute", "n", F.sum("n").over(w).alias("sliding"))


def recent_counts(mentions: DataFrame, now: datetime, unit_seconds: float, slots: int = 12) -> DataFrame:
    """(trend_id, history): posts of each of the last ``slots`` units up to ``now``, oldest first, from the trend's first unit on.

    Rows are reduced to (trend, unit) first; a trend holds ``slots`` numbers at most.
    """
    back = F.floor(age_seconds(F.col("published_at"), now) / F.lit(float(unit_seconds)))
    per = mentions.where(F.col("published_at") <= ts(now)).groupBy("trend_id", back.alias("back")).agg(F.count("*").alias("n"))
    held = per.groupBy("trend_id").agg(
        F.max("back").alias("first"), F.collect_list(F.when(F.col("back") < slots, F.struct("back", "n"))).alias("c"))
    counts = F.map_from_entries("c")
    units = F.sequence(F.least(F.col("first"), F.lit(slots - 1)), F.lit(0).cast("bigint"))
    return held.select("trend_id", F.transform(units, lambda b: F.coalesce(F.try_element_at(counts, b), F.lit(0)).cast("double")).alias("history"))
