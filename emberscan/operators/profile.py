"""Per-trend counts, distinct counts, window counts and source mix in one pass."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.numeric import entropy, xlog2x
from ..functions.times import age_hours, ts, within


def lookup(col: Column, table: dict, default) -> Column:
    """Value of a small fixed table for ``col`` as a literal-map lookup."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), col), F.lit(default))


def base_counts(mentions: DataFrame) -> DataFrame:
    """Mentions, authors, sources, communities and distinct media urls per trend.

    Each distinct count is planned as a pre-aggregation on (trend, value), so a
    trend that holds a third of the rows is still spread over all tasks.
    """
    media = F.col("source").isin(params.MEDIA)
    return mentions.groupBy("trend_id").agg(
        F.count("*").alias("mentions"),
        F.count_distinct("author_id").alias("unique_authors"),
        F.count_distinct("source").alias("unique_sources"),
        F.count_distinct(F.coalesce("community", "source")).alias("unique_communities"),
        F.count_distinct(F.when(media, F.col("url"))).alias("media_urls"),
    )


def trend_profile(
    mentions: DataFrame,
    now: datetime,
    windows: params.Trailing = params.Trailing(),
    trust: dict | None = None,
) -> DataFrame:
    """Everything the early score needs, one row per trend, from one scan.

    Rows are first reduced to (trend, source, author), then to the two grouping
    sets (trend, author) and (trend, source), then to the trend. All three steps
    are plain sums with map-side combine: no distinct, no collected group, and a
    hot trend is spread by author before it is brought together.
    """
    trust = params.TRUST_STRICT if trust is None else trust
    t = F.col("published_at")
    unit = windows.scale
    decay = F.exp(F.lit(-0.6931471805599453 / params.HALF_LIFE_HOURS) * F.greatest(F.lit(0.0), age_hours(t, now) / unit))
    fine = mentions.groupBy("trend_id", "source", "author_id").agg(
        F.count("*").alias("n"),
        F.count_if(within(t, now, windows.short)).alias("m15"),
        F.count_if(within(t, now, windows.mid)).alias("m30"),
        F.count_if(within(t, now, windows.long)).alias("m60"),
        F.count_if(t >= ts(now, -windows.long)).alias("c60"),
        F.count_if(t < ts(now, -windows.day)).alias("old"),
        F.sum(decay).alias("w"),
        F.min(t).alias("first_seen"),
        F.max(t).alias("last_seen"),
    )
    sums = ["n", "m15", "m30", "m60", "c60", "old", "w"]
    parts = fine.groupingSets(
        [["trend_id", "author_id"], ["trend_id", "source"]], "trend_id", "author_id", "source"
    ).agg(
        F.grouping("source").alias("by_author"),
        *[F.sum(c).alias(c) for c in sums],
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    author, src = F.col("by_author") == 1, F.col("by_author") == 0

    def over(cond: Column, value: Column) -> Column:
        return F.when(cond, value)

    social = F.col("source").isin(params.SOCIAL)
    out = parts.groupBy("trend_id").agg(
        *[F.sum(over(author, F.col(c))).alias({"n": "mentions", "w": "weighted_volume", "old": "older"}.get(c, c))
          for c in sums if c != "c60"],
        F.count_if(author).alias("unique_authors"),
        F.count_if(author & (F.col("m60") > 0)).alias("authors60"),
        F.max(over(author, F.col("c60"))).alias("max_author60"),
        F.max(over(author, F.col("n"))).alias("max_author"),
        F.count_if(src).alias("unique_sources"),
        F.count_if(src & (F.col("m60") > 0)).alias("sources60"),
        F.count_if(src & (F.col("m15") > 0)).alias("sources15"),
        F.max(over(src, F.col("n"))).alias("max_source"),
        F.max(over(src, F.col("m60"))).alias("max_source60"),
        F.sum(over(src & social, F.col("m60"))).alias("social60"),
        F.sum(over(src, xlog2x(F.col("m15")))).alias("_x15"),
        F.sum(over(src, xlog2x(F.col("n")))).alias("_xall"),
        F.sum(over(src, F.col("n") * lookup(F.col("source"), trust, params.TRUST_DEFAULT))).alias("_trust"),
        F.max_by(over(src, F.col("source")), over(src, F.struct(F.col("n"), -F.unix_micros(F.col("first_seen").cast("timestamp"))))).alias("primary_source"),
        F.array_sort(F.collect_set(over(src, F.col("source")))).alias("sources"),
        F.map_from_entries(F.array_sort(F.collect_list(over(src, F.struct("source", "n"))))).alias("source_counts"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    h15 = F.when((F.col("m15") > 0) & (F.col("sources15") > 1),
                 F.least(F.lit(1.0), entropy(F.col("m15"), F.col("_x15"), F.col("sources15")))).otherwise(F.lit(0.0))
    hall = F.when(F.col("unique_sources") > 1,
                  F.least(F.lit(1.0), entropy(F.col("mentions"), F.col("_xall"), F.col("unique_sources")))).otherwise(F.lit(0.0))
    return out.select(
        "*",
        h15.alias("entropy15"),
        hall.alias("entropy_all"),
        (F.col("_trust") / F.col("mentions")).alias("trust"),
        (F.col("weighted_volume") / F.col("mentions")).alias("freshness"),
        (age_hours(F.col("first_seen"), now) / unit).alias("age_hours"),
        (age_hours(F.col("last_seen"), now) / unit).alias("idle_hours"),
    ).drop("_x15", "_xall", "_trust")


def source_counts(mentions: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Zero-filled mention count per (trend, source), one row per pair."""
    names = params.SOURCES if sources is None else sources
    wide = mentions.groupBy("trend_id").agg(*[F.count_if(F.col("source") == s).alias(s) for s in names])
    return wide.select(
        "trend_id",
        F.explode(F.map_from_arrays(F.array(*[F.lit(s) for s in names]), F.array(*names))).alias("source", "mentions"),
    )


def top_author_share(mentions: DataFrame, now: datetime, windows: params.Trailing = params.Trailing()) -> DataFrame:
    """Largest author count in the long window and the author's share of it."""
    t = F.col("published_at")
    per_author = mentions.where(t >= ts(now, -windows.long)).groupBy("trend_id", "author_id").agg(
        F.count("*").alias("c"), F.count_if(within(t, now, windows.long)).alias("m")
    )
    return per_author.groupBy("trend_id").agg(
        F.max("c").alias("max_author60"), F.sum("m").alias("m60"),
        (F.max("c") / F.greatest(F.lit(1), F.sum("m"))).alias("author_share"),
    )


def recycle_ratio(mentions: DataFrame, now: datetime, old_seconds: float = 86400.0) -> DataFrame:
    """Share of mentions older than ``old_seconds``."""
    old = (F.col("published_at") < ts(now, -old_seconds)).cast("int")
    return mentions.groupBy("trend_id").agg(F.avg(old).alias("old_ratio"))


def source_mix(mentions: DataFrame, now: datetime, windows: params.Trailing = params.Trailing()) -> DataFrame:
    """Dominant source share and social corroboration.

    ``share60`` compares like with like; ``share_mixed`` divides an all-time
    count by the window total and can exceed 1.
    """
    per = mentions.groupBy("trend_id", "source").agg(
        F.count("*").alias("n"), F.count_if(within(F.col("published_at"), now, windows.long)).alias("m60")
    )
    total = F.sum("m60")
    return per.groupBy("trend_id").agg(
        F.when(total > 0, F.max("m60") / total).otherwise(F.lit(0.0)).alias("share60"),
        F.when(total > 0, F.max("n") / total).otherwise(F.lit(0.0)).alias("share_mixed"),
        F.coalesce(F.bool_or(F.col("source").isin(params.SOCIAL) & (F.col("m60") > 0)), F.lit(False)).alias("has_social"),
    )


def weighted_sentiment(mentions: DataFrame, now: datetime, tau_hours: float = 6.0) -> DataFrame:
    """Sentiment weighted by author quality and recency; NULL sentiment is skipped."""
    w = F.coalesce("author_quality", F.lit(0.5)) * F.exp(-age_hours(F.col("published_at"), now) / tau_hours)
    has = F.col("sentiment").isNotNull()
    den = F.sum(F.when(has, w))
    return mentions.groupBy("trend_id").agg(
        F.coalesce(F.sum(F.when(has, w * F.col("sentiment"))) / F.nullif(den, F.lit(0.0)), F.lit(0.0)).alias("sentiment")
    )


def author_quality(verified: Column, age_days: Column, followers: Column, bot: Column, institutional: Column) -> Column:
    """Quality of an author in 0..1; institutions without a person get 0.6."""
    tenure = F.least(F.lit(1.0), age_days / 365.0)
    reach = F.least(F.lit(1.0), F.log10(1 + followers) / 5.0)
    raw = 0.5 + 0.2 * verified.cast("int") + 0.2 * tenure + 0.1 * reach - 0.5 * bot
    return F.when(institutional, F.lit(0.6)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def origin_quality_first5(mentions: DataFrame) -> DataFrame:
    """Mean author quality of the five earliest mentions (0.5 where unknown).

    Spark keeps five rows per trend and input partition before the shuffle, so
    the window never sees a whole trend.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("trend_id").orderBy("published_at", "external_id")
    first5 = mentions.select(
        "trend_id", "published_at", "external_id", "author_id", "author_quality", F.row_number().over(w).alias("rn")
    ).where("rn <= 5")
    return first5.groupBy("trend_id").agg(
        F.avg(F.coalesce("author_quality", F.lit(0.5))).alias("origin_quality"),
        F.max(F.when((F.col("rn") == 1) & (F.coalesce("author_quality", F.lit(0.0)) >= 0.5), F.col("author_id"))).alias("originator"),
    )
