"""Reports, counters, engine statistics and evaluation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.numeric import ratio
from ..functions.times import bucket, micros, ts, within


def unique_authors_sketch(mentions: DataFrame) -> DataFrame:
    """Mergeable HyperLogLog sketch of the authors per (trend, hour)."""
    return mentions.groupBy("trend_id", bucket(F.col("published_at"), 3600).alias("bucket")).agg(
        F.hll_sketch_agg("author_id", F.lit(14)).alias("sketch"))


def unique_authors_estimate(sketches: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """Estimated distinct authors of the last hours, from the hourly sketches."""
    return sketches.where(F.col("bucket") > ts(now, -hours * 3600)).groupBy("trend_id").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_authors"))


def engine_stats_daily(runs: DataFrame) -> DataFrame:
    """Daily engine statistics. ``runs``: (engine, at, latency_ms, ok).

    Latencies are whole milliseconds, so they are first counted per value; the
    percentiles then weigh values by count and no engine-day is ever collected.
    """
    per = runs.groupBy(F.to_date("at").alias("stat_date"), "engine", "latency_ms").agg(
        F.count("*").alias("c"), F.count_if(~F.col("ok")).alias("errors"))
    n = F.sum("c")
    return per.groupBy("stat_date", "engine").agg(
        n.alias("analyzed"), F.sum("errors").alias("errors"), (F.sum(F.col("latency_ms") * F.col("c")) / n).alias("avg_latency"),
        F.max("latency_ms").alias("max_latency"), F.percentile("latency_ms", F.lit(0.95), F.col("c")).alias("p95_latency"),
        F.percentile("latency_ms", F.lit(0.99), F.col("c")).alias("p99_latency"), (n / 86400.0).alias("qps"))


def ingest_stats(mentions: DataFrame, tick_seconds: int, enabled: list[str], sources: list[str] | None = None) -> DataFrame:
    """Items per source and tick, running total and health, silent sources included."""
    names = params.SOURCES if sources is None else sources
    per = mentions.groupBy(bucket(F.col("published_at"), tick_seconds).alias("tick")).agg(
        F.count_distinct("doc_id").alias("unique_hashes"), *[F.count_if(F.col("source") == s).alias(s) for s in names])
    long = per.select("tick", "unique_hashes", F.explode(F.map_from_arrays(F.array(*[F.lit(s) for s in names]), F.array(*names))).alias("source", "items"))
    w = Window.partitionBy("source").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    health = F.when(F.col("items") > 0, "online").when(F.col("source").isin(enabled), "degraded").otherwise("offline")
    return long.withColumns({"total": F.sum("items").over(w), "health": health})


def report_kpis(trends: DataFrame, seen_after=None) -> DataFrame:
    """Counts by source, by phase and overall in one pass over grouping sets."""
    if seen_after is not None:
        trends = trends.where(F.col("last_seen") > seen_after)
    g = trends.groupingSets([["primary_source"], ["phase"], []], "primary_source", "phase").agg(
        F.grouping_id().alias("gid"), F.count("*").alias("clusters"), F.sum("mentions").alias("mentions"),
        F.max("score").alias("top_score"), F.avg("score").alias("avg_score"))
    level = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "source").otherwise("phase")
    return g.select(level.alias("level"), F.coalesce("primary_source", "phase", F.lit("all")).alias("value"), "clusters", "mentions", "top_score", "avg_score")


def lead_times(mentions: DataFrame) -> DataFrame:
    """Seconds between the first mention and the first media mention; NULL = no media yet."""
    us = micros(F.col("published_at"))
    media = F.min(F.when(F.col("source").isin(params.MEDIA), us))
    return mentions.groupBy("trend_id").agg(
        F.min(us).alias("first_us"), media.alias("media_us"), ((media - F.min(us)) / F.lit(1e6)).alias("lead_seconds"))


def spread_order(mentions: DataFrame, now: datetime, recent_seconds: float = 3600.0) -> DataFrame:
    """Sources of a trend in order of first sight with gaps; flag for fast spread.

    The windows run over (trend, source) rows, a handful per trend.
    """
    first = mentions.groupBy("trend_id", "source").agg(F.min("published_at").alias("first_seen"))
    w = Window.partitionBy("trend_id").orderBy("first_seen", "source")
    gap = (micros(F.col("first_seen")) - micros(F.lag("first_seen").over(w))) / F.lit(1e6)
    fresh = F.sum(within(F.col("first_seen"), now, recent_seconds).cast("int")).over(Window.partitionBy("trend_id"))
    return first.select("trend_id", "source", "first_seen", F.row_number().over(w).alias("ord"), gap.alias("gap_seconds"), (fresh >= 2).alias("spreading_fast"))


def source_panel(mentions: DataFrame, now: datetime, seconds: float) -> DataFrame:
    """Mentions per (trend, source) in the window and growth against the one before."""
    t = F.col("published_at")
    cur, prev = within(t, now, seconds), within(t, now, 2 * seconds) & ~within(t, now, seconds)
    a = mentions.where(within(t, now, 2 * seconds)).groupBy("trend_id", "source").agg(F.count_if(cur).alias("mentions"), F.count_if(prev).alias("previous"))
    return a.withColumn("growth_pct", F.round(ratio(F.col("mentions") - F.col("previous"), F.col("previous")) * 100, 2))


def period_report(mentions: DataFrame, now: datetime, days: int, periods: int = 2) -> DataFrame:
    """Detected and confirmed trends, accuracy, lead time per period, with the one before.

    A story is a (trend, community); it is detected in the period of its first
    post and confirmed by a later media post.
    """
    us = micros(F.col("published_at"))
    first = mentions.groupBy("trend_id", "community").agg(F.min(us).alias("first_us"))
    media = mentions.where(F.col("source").isin(params.MEDIA)).groupBy("trend_id").agg(F.min(us).alias("any_media"), F.max(us).alias("last_media"))
    s = first.join(media, "trend_id", "left")
    per = F.floor((F.lit(_us(now)) - F.col("first_us")) / F.lit(days * 86_400_000_000)).alias("periods_back")
    confirmed = F.coalesce(F.col("last_media") > F.col("first_us"), F.lit(False))
    lead = F.when(F.col("any_media") > F.col("first_us"), (F.col("any_media") - F.col("first_us")) / F.lit(3.6e9))
    a = s.groupBy(per).agg(F.count("*").alias("detected"), F.count_if(confirmed).alias("confirmed"), F.avg(lead).alias("lead_hours"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("periods_back"))  # a few periods
    a = a.withColumns({"accuracy": 100.0 * F.col("confirmed") / F.col("detected"), "detected_prev": F.lag("detected").over(w)})
    a = a.withColumn("change_pct", 100.0 * (F.col("detected") - F.col("detected_prev")) / F.col("detected_prev"))
    return a.where(F.col("periods_back") < periods)


def period_sources(mentions: DataFrame, now: datetime, days: int) -> DataFrame:
    """Stories per period by the source of their first post, with the share of the period in per cent."""
    key = F.struct(micros(F.col("published_at")).alias("us"), "external_id", "source")
    first = mentions.groupBy("trend_id", "community").agg(F.min(key).alias("f"))
    per = F.floor((F.lit(_us(now)) - F.col("f.us")) / F.lit(days * 86_400_000_000)).alias("periods_back")
    n = first.groupBy(per, F.col("f.source").alias("source")).agg(F.count("*").alias("detected"))
    whole = n.groupBy("periods_back").agg(F.sum("detected").alias("all"))
    return n.join(whole, "periods_back").select("periods_back", "source", "detected", (100.0 * F.col("detected") / F.col("all")).alias("pct"))


def period_top_delta(mentions: DataFrame, now: datetime, days: int) -> DataFrame:
    """Trend that grew most in a period against the period before it, in per cent of the mentions there."""
    per = F.floor((F.lit(_us(now)) - micros(F.col("published_at"))) / F.lit(days * 86_400_000_000)).alias("periods_back")
    n = mentions.groupBy("trend_id", per).agg(F.count("*").alias("mentions"))
    before = n.select("trend_id", (F.col("periods_back") - 1).alias("periods_back"), F.col("mentions").alias("previous"))
    delta = 100.0 * (F.col("mentions") - F.col("previous")) / F.col("previous")
    best = n.join(before, ["trend_id", "periods_back"]).withColumn("delta_pct", F.round(delta, 6)).groupBy("periods_back").agg(
        F.min(F.struct((-F.col("delta_pct")).alias("d"), "trend_id")).alias("b"))
    return best.select("periods_back", "b.trend_id", (-F.col("b.d")).alias("delta_pct"))


def top_by_period(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every period with their rank; each task keeps ``k`` before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def detections_by_hour(mentions: DataFrame) -> DataFrame:
    """Stories by hour of day of their first post, all 24 hours."""
    first = mentions.groupBy("trend_id", "community").agg(F.min("published_at").alias("f"))
    counts = first.agg(F.array(*[F.count_if(F.hour("f") == i) for i in range(24)]).alias("c"))
    return counts.select(F.posexplode("c").alias("hour", "detected"))


def _us(now: datetime) -> int:
    from ..functions.times import epoch_micros

    return epoch_micros(now)


def dashboard(trends: DataFrame) -> DataFrame:
    return trends.agg(F.count_if(F.col("phase").isin("forming", "rising")).alias("emerging"),
                      F.count_if((F.col("score") >= 20) & (F.col("score") < 50)).alias("weak"), F.count("*").alias("trends"))


def alert_counters(rules: DataFrame, fired: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Active rules, alerts in all, and alerts nobody has acknowledged.

    ``acknowledged``: (rule_id, trend_id, fire_no).
    """
    open_ = fired.join(acknowledged, ["rule_id", "trend_id", "fire_no"], "left_anti").agg(F.count("*").alias("unack"))
    return rules.agg(F.count_if("armed").alias("active")).crossJoin(fired.agg(F.count("*").alias("total"))).crossJoin(open_)  # one row each


def saved_counts(saved: DataFrame) -> DataFrame:
    """Saved entries by folder with the total (rollup), pinned and without folder."""
    r = saved.rollup("folder").agg(
        F.grouping("folder").alias("g"), F.count("*").alias("n"), F.count_if("pinned").alias("pinned"), F.count_if(F.coalesce("folder", F.lit("")) == "").alias("none"))
    return r.select(F.when(F.col("g") == 1, "(all)").otherwise(F.coalesce("folder", F.lit("(none)"))).alias("folder"), "n", "pinned", "none")


def amplifiers(mentions: DataFrame, k: int = 20) -> DataFrame:
    """Most active authors per trend with their delay to the first post."""
    us = micros(F.col("published_at"))
    per = mentions.groupBy("trend_id", "author_id").agg(F.count("*").alias("posts"), F.min(us).alias("first_us"))
    origin = per.groupBy("trend_id").agg(F.min("first_us").alias("origin_us"))
    w = Window.partitionBy("trend_id").orderBy(F.desc("posts"), "first_us", "author_id")
    top = per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(origin, "trend_id").select("trend_id", "author_id", "posts", "rank", ((F.col("first_us") - F.col("origin_us")) / F.lit(1e6)).alias("offset_seconds"))


def evaluate(predicted: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Precision, recall and false-positive rate of a flag against labels, and the mean lead of what was rightly flagged.

    ``predicted``: (key, predicted, lead_hours).
    """
    j = predicted.join(labels, key)
    p, y = F.col("predicted"), F.col("actual")
    tp, fp, fn, tn = (F.count_if(p & y), F.count_if(p & ~y), F.count_if(~p & y), F.count_if(~p & ~y))
    return j.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), ratio(tp, tp + fp).alias("precision"),
                 ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("false_positive_rate"),
                 F.avg(F.when(p & y, F.col("lead_hours"))).alias("mean_lead_hours"))


# Heading of the exported table.
MARKDOWN_HEAD = ["| # | Tendencia | Fuente | Menciones/h | Delta | Confianza |", "|---|-----------|--------|-------------|-------|-----------|"]


def markdown_rows(ranked: DataFrame) -> DataFrame:
    """A Markdown table: its two heading lines at positions -1 and 0, then one line per ranked trend."""
    d = F.col("delta")
    rows = ranked.select("position", F.format_string(
        "| %d | %s | %s | %d | %s%d%% | %d/100 |", F.col("position"), F.col("title"), F.col("source"), F.col("mentions"),
        F.when(d > 0, "+").otherwise(""), d, F.col("confidence")).alias("line"))
    head = ranked.sparkSession.createDataFrame([(i - 1, line) for i, line in enumerate(MARKDOWN_HEAD)], "position int, line string")
    return head.unionByName(rows)


def json_rows(ranked: DataFrame) -> DataFrame:
    """The same report as one JSON object per trend."""
    return ranked.select("position", F.to_json(F.struct("position", "title", "source", "mentions", "delta", "confidence")).alias("line"))


def conversations(mentions: DataFrame, roots: DataFrame, limit: int = 20) -> DataFrame:
    """Threads by root post with their engagement, newest activity first."""
    j = mentions.join(roots.select(F.col("id").alias("external_id"), "root"), "external_id")
    per = j.groupBy("root").agg(F.count("*").alias("posts"), F.count_distinct("author_id").alias("authors"), F.sum("reach").alias("reach"),
                                F.max("published_at").alias("last_at"))
    return per.orderBy(F.desc("last_at"), "root").limit(limit)


def history_feed(spread: DataFrame, changes: DataFrame, ticks: DataFrame, velocity_over: float) -> DataFrame:
    """Detection, cross-source, threshold, amplification and phase events of a trend in time order.

    A source that joins after the velocity went over the threshold amplifies; one that joins before it corroborates.
    """
    first = ticks.where(F.col("velocity") > velocity_over).groupBy("trend_id").agg(F.min("at").alias("over"))
    later = F.when(F.col("first_seen") > F.col("over"), "amplification").otherwise("cross_source")
    det = spread.join(first, "trend_id", "left").select(
        "trend_id", F.col("first_seen").alias("at"), F.when(F.col("ord") == 1, "detection").otherwise(later).alias("tag"), F.col("source").alias("detail"))
    over = first.select("trend_id", F.col("over").alias("at"), F.lit("threshold").alias("tag"), F.lit(str(velocity_over)).alias("detail"))
    ph = changes.select("trend_id", F.col("bucket_time").alias("at"), F.lit("phase").alias("tag"), F.concat_ws(">", "from_phase", "to_phase").alias("detail"))
    return det.unionByName(over).unionByName(ph)


def vitals(mentions: DataFrame, step_seconds: int, silent_seconds: int) -> DataFrame:
    """Analysed posts per step, change against the step before, rate, silence flag."""
    per = mentions.groupBy(bucket(F.col("published_at"), step_seconds).alias("at")).agg(F.count("*").alias("analysed"), F.max("published_at").alias("last"))
    w = Window.partitionBy(F.lit(1)).orderBy("at")  # one row per step of the clock
    gap = (micros(F.col("at")) - micros(F.lag("last").over(w))) / F.lit(1e6)
    return per.select("at", "analysed", (F.col("analysed") - F.coalesce(F.lag("analysed").over(w), F.lit(0))).alias("change"),
                      (F.col("analysed") / F.lit(float(step_seconds))).alias("per_second"), F.coalesce(gap > silent_seconds, F.lit(False)).alias("degraded"))


def alert_feed(alerts: DataFrame, since, limit: int = 50) -> DataFrame:
    return alerts.where(F.col("fired_at") > since).orderBy("fired_at", "rule_id", "trend_id").limit(limit)
