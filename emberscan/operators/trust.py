"""Legitimacy, trash, pre-burst and origin scores."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp01, entropy, ratio, xlog2x
from ..functions.times import ts, within
from .dedup import gap_starts


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def product_score(vel_terms: dict[str, float], mat_terms: dict[str, float], vel_bias: float = 0.0, gamma: float = 1.0,
                  penalties: list[str] = (), idle_hours: str = "idle_hours", half_life: float = 12.0) -> Column:
    """``100 * Vel * Mat^gamma * Pen * Decay``. The weights are the caller's to set."""
    vel = sigmoid(sum((F.col(c) * w for c, w in vel_terms.items()), F.lit(vel_bias)))
    mat = sigmoid(sum((F.col(c) * w for c, w in mat_terms.items()), F.lit(0.0)))
    pen = F.lit(1.0)
    for p in penalties:
        pen = pen * F.col(p)
    return 100 * vel * F.pow(mat, F.lit(gamma)) * pen * F.exp(F.lit(-math.log(2) / half_life) * F.col(idle_hours))


def phase_rules(vel: Column, mat: Column, accel: Column, age_hours: Column) -> Column:
    """Four-phase rules; the narrower rule is tried before the wider one."""
    return (
        F.when((vel < 0.25) & (accel < -0.5) & (age_hours > 4), "decaying")
        .when((mat > 0.7) & (vel < 0.45), "peaked")
        .when((vel > 0.6) & (mat < 0.75) & (accel > 0), "rising")
        .when((vel > 0.3) & (mat < 0.5) & (accel >= 0), "forming").otherwise("undetermined"))


def legitimacy(x: Column, gdelt: Column, reddit: Column, hn: Column, trash: Column) -> Column:
    """STRUCT<class, confidence> from the sources present and the trash score."""
    other = gdelt | reddit
    pair = lambda name, c: F.struct(F.lit(name).alias("class"), F.lit(c).alias("confidence"))
    return (
        F.when(x & other & (trash < 0.4), pair("LEGIT", 0.92))
        .when(x & ~other & (trash > 0.5), pair("BOT_CAMPAIGN", 0.85))
        .when(x & ~other & (trash < 0.4), pair("NATIVE", 0.55))
        .when(other & ~x, pair("PRE_BURST", 0.7))
        .when(~x & ~other, pair("NOISE", 0.2)).otherwise(pair("UNCERTAIN", 0.5)))


def trash_flags() -> Column:
    """ARRAY<STRUCT<name,weight>> of the flags that are raised."""
    c = F.col
    rules = [
        ("new_accounts", 0.3, c("new_account_ratio") > 0.4), ("sync_posting", 0.4, c("sync_ratio") > 0.2),
        ("dup_content", 0.4, c("duplicate_ratio") > 0.3),
        ("coordinated_cluster", 0.5, (c("network_density") > 0.7) & (c("community_share") > 0.85)),
        ("copy_paste_campaign", 0.4, (c("sentiment_std") < 0.05) & (c("hashtag_jaccard") > 0.7)),
        ("non_human_cadence", 0.3, c("hour_uniformity") < 0.1), ("spammy_urls", 0.2, c("shortener_ratio") > 0.5),
        ("media_recycle", 0.3, c("media_dup_ratio") > 0.4),
    ]
    return F.array_compact(F.array(*[
        F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"))) for n, w, on in rules]))


def trash_score(flags: Column) -> Column:
    """Noisy-or of the raised flags."""
    return 1 - F.aggregate(flags, F.lit(1.0), lambda p, f: p * (1 - f["weight"]))


def trash_band(score: Column) -> Column:
    return F.when(score < 0.3, "clean").when(score < 0.6, "anomalous").otherwise("hidden")


def combined_trash(heuristic: Column, anomaly: Column, graph: Column) -> Column:
    return 0.4 * heuristic + 0.3 * anomaly + 0.3 * graph


def hashtag_jaccard(tagged: DataFrame, small: int = 8, share: int = 5_000) -> DataFrame:
    """Mean Jaccard of the tag sets over all pairs of posts of a trend, exactly.

    Equal sets are folded to one row with its count. Pairs of sets of at most
    ``small`` tags are counted, not listed: inclusion and exclusion over at most
    2^small subsets. A pair with a larger set is met once, at the first tag that
    both have; its cost is the number of distinct sets that share a tag with a
    larger one. Tags of more than ``share`` sets are dealt over several tasks.
    ``small`` and ``share`` decide the cost only, not the result.
    ``tagged``: (trend_id, tags) with posts that have at least one tag.
    """
    rows = tagged.select("trend_id", F.array_sort(F.array_distinct("tags")).alias("tags")).where(F.size("tags") > 0)
    kinds = rows.groupBy("trend_id", "tags").agg(F.count("*").alias("c"))
    large = kinds.where(F.size("tags") > small)
    same = large.select("trend_id", (F.col("c") * (F.col("c") - 1) / 2).alias("j"))
    parts = _small_pairs(kinds.where(F.size("tags") <= small)).unionByName(same).unionByName(_large_pairs(kinds, small, share))
    n, total = kinds.groupBy("trend_id").agg(F.sum("c").alias("n")), parts.groupBy("trend_id").agg(F.sum("j").alias("j"))
    j = F.coalesce("j", F.lit(0.0))  # trends without any common tag
    return n.join(total, "trend_id", "left").select("trend_id", (j / F.nullif(F.col("n") * (F.col("n") - 1) / 2.0, F.lit(0.0))).alias("hashtag_jaccard"))


def _small_pairs(kinds: DataFrame) -> DataFrame:
    """Sums of Jaccard over the pairs of sets that are small, with those of equal sets."""
    subsets = F.aggregate("tags", F.array(F.array().cast("array<string>")), lambda acc, t: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(t)))))
    ex = kinds.select("trend_id", F.size("tags").alias("p"), "c", F.explode(F.filter(subsets, lambda s: F.size(s) > 0)).alias("s"))
    per = ex.groupBy("trend_id", "s", "p").agg(F.sum("c").alias("c"))
    # Sizes of tag sets are few, so the sizes of one S fit in a short array.
    by_s = per.groupBy("trend_id", "s").agg(F.collect_list(F.struct("p", "c")).alias("x"))
    cross = by_s.select("trend_id", F.size("s").alias("k"), F.explode("x").alias("a"), "x").select("trend_id", "k", "a", F.explode("x").alias("b")).where("a.p <= b.p")
    ca, cb = F.col("a.c"), F.col("b.c")
    pairs = F.when(F.col("a.p") == F.col("b.p"), ca * (ca - 1) / 2).otherwise((ca * cb).cast("double"))
    size = F.col("a.p") + F.col("b.p")
    k = F.col("k")
    choose = lambda o: F.exp(_log_factorial(k) - _log_factorial(o) - _log_factorial(k - o))
    weight = F.aggregate(
        F.sequence(F.lit(1), k), F.lit(0.0),
        lambda acc, o: acc + F.when((k - o) % 2 == 0, 1.0).otherwise(-1.0) * choose(o) * o / (size - o))
    return cross.groupBy("trend_id").agg(F.sum(pairs * weight).alias("j"))


def _large_pairs(kinds: DataFrame, small: int, share: int) -> DataFrame:
    """Sums of Jaccard over the pairs of different sets of which one at least is large."""
    each = kinds.select("trend_id", F.explode("tags").alias("tag"), "tags", "c")
    big = F.size("tags") > small
    # Only tags of large sets; a tag of many sets is dealt to a grid of (left, right) shares.
    count = each.groupBy("trend_id", "tag").agg(F.count_if(big).alias("l"), F.count("*").alias("r")).where("l > 0").select(
        F.col("trend_id").alias("t"), F.col("tag").alias("g"), *[F.ceil(F.col(x) / F.lit(float(share))).cast("int").alias(x) for x in ("l", "r")])
    dealt = each.join(count, F.col("trend_id").eqNullSafe(F.col("t")) & F.col("tag").eqNullSafe(F.col("g"))).drop("t", "g")
    own = lambda of: F.pmod(F.hash("tags"), F.col(of))
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    a = dealt.where(big).select("trend_id", "tag", own("l").alias("x"), all_of("r").alias("y"), F.col("tags").alias("a"), F.col("c").alias("ca")).alias("a")
    b = dealt.select("trend_id", "tag", all_of("l").alias("x"), own("r").alias("y"), F.col("tags").alias("b"), F.col("c").alias("cb")).alias("b")
    met = a.join(b, F.col("a.trend_id").eqNullSafe(F.col("b.trend_id")) & F.col("a.tag").eqNullSafe(F.col("b.tag")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
                 & ((F.size("b") <= small) | (F.col("a.a") < F.col("b.b"))))
    both = met.select("a.trend_id", F.col("a.tag").alias("tag"), F.array_intersect("a", "b").alias("both"), (F.size("a") + F.size("b")).alias("size"), (F.col("ca") * F.col("cb")).alias("pairs"))
    o = F.size("both")
    return both.where(F.col("tag").eqNullSafe(F.get("both", F.lit(0)))).groupBy("trend_id").agg(F.sum(F.col("pairs") * o / (F.col("size") - o)).alias("j"))


def _log_factorial(x: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), x)), F.lit(0.0), lambda a, v: a + F.log(v.cast("double")))


def post_features(posts: DataFrame, sync_seconds: int = 60, shorteners: tuple[str, ...] = ("bit.ly", "tinyurl.com", "t.co", "goo.gl")) -> DataFrame:
    """Features of a trend that come from its posts alone.

    ``posts`` needs text_hash, host, lang and author_age_days besides the mention
    columns. Hour and language histograms are sums per (trend, value).
    """
    base = posts.groupBy("trend_id").agg(
        F.count("*").alias("n"),
        (F.count_distinct(F.when(F.col("author_age_days") < 30, F.col("author_id"))) / F.count_distinct("author_id")).alias("new_account_ratio"),
        F.avg(F.col("host").isin(*shorteners).cast("int")).alias("shortener_ratio"),
        F.stddev_pop("sentiment").alias("sentiment_std"),
        (1 - F.count_distinct("url") / F.count("*")).alias("media_dup_ratio"))
    dup = posts.groupBy("trend_id", "text_hash").agg(F.count("*").alias("c")).groupBy("trend_id").agg(
        (F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("duplicate_ratio"))
    hours = posts.groupBy("trend_id", F.hour("published_at").alias("h")).agg(F.count("*").alias("c")).groupBy("trend_id").agg(
        entropy(F.sum("c"), F.sum(xlog2x(F.col("c"))), F.lit(24)).alias("burst_entropy")).withColumn("hour_uniformity", 1 - F.col("burst_entropy"))
    langs = posts.groupBy("trend_id", "lang").agg(F.count("*").alias("c")).groupBy("trend_id").agg((F.max("c") / F.sum("c")).alias("language_skew"))
    starts = gap_starts(posts, ["trend_id"], "published_at", "external_id", sync_seconds, min(60, sync_seconds))
    sync = starts.groupBy("trend_id").agg((1 - F.count_if("opens") / F.sum("n")).alias("sync_ratio"))
    out = base
    for part in (dup, hours, langs, sync):
        out = out.join(part, "trend_id")
    return out


def network_features(replies: DataFrame, authors: DataFrame) -> DataFrame:
    """Density and reciprocity of the reply graph among a trend's authors.

    ``replies``: (trend_id, src, dst) author to author. ``authors``: (trend_id, n).
    """
    d = replies.where("src <> dst").select("trend_id", "src", "dst").distinct()
    und = d.select("trend_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("trend_id", "a", "b").agg(F.count("*").alias("ways"))
    per = und.groupBy("trend_id").agg(F.count("*").alias("m"), F.sum("ways").alias("directed"), F.sum(F.when(F.col("ways") == 2, 2).otherwise(0)).alias("mutual"))
    n = F.col("n")
    return authors.join(per, "trend_id", "left").select(
        "trend_id", F.coalesce(2 * F.col("m") / F.nullif((n * (n - 1)).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("network_density"),
        F.coalesce(ratio(F.col("mutual"), F.col("directed")), F.lit(0.0)).alias("mutual_ratio"))


def transitions(history: DataFrame) -> DataFrame:
    """Forming to rising and formed to decayed along a trend's tick history.

    ``history``: (trend_id, at, acceleration, communities, author_entropy,
    origin_quality, trash), one row per tick.
    """
    facts = history.groupBy("trend_id").agg(F.stddev_pop("acceleration").alias("sigma"), F.percentile("author_entropy", F.lit(0.4)).alias("p40"))
    w = Window.partitionBy("trend_id").orderBy("at")
    h = history.withColumns({"prev_comm": F.lag("communities").over(w), "prev_accel": F.lag("acceleration").over(w)}).join(facts, "trend_id")
    a, s = F.col("acceleration"), F.col("sigma")
    rising = (a > 0.5 * s) & (F.col("communities") - F.col("prev_comm") >= 2) & (F.col("author_entropy") >= F.col("p40")) & (F.col("origin_quality") > 0.5) & (F.col("trash") < 0.4)
    return h.select("trend_id", "at", F.coalesce(rising, F.lit(False)).alias("to_rising"),
                    F.coalesce((a < -0.3 * s) & (F.col("prev_accel") < -0.3 * s), F.lit(False)).alias("to_decayed"))


def pre_burst(posts: DataFrame, now: datetime, scale: float = 1.0, prior: float = 0.2, likelihood: float = 4.0) -> DataFrame:
    """Weak signals per trend and their combined evidence.

    Signals: a community grew more than five-fold within six hours; a host was
    linked by more than five posts within 30 minutes; mean sentiment moved by
    more than 0.3 within an hour. At least two signals from different sources and
    a posterior above 0.7 confirm a forming story.
    """
    t = F.col("published_at")
    h = 3600 * scale

    def span(a, b):
        return (t > ts(now, -a)) & (t <= ts(now, -b))

    comm = posts.where(within(t, now, 12 * h)).groupBy("trend_id", "source", "community").agg(
        F.count_if(span(6 * h, 0)).alias("c"), F.count_if(span(12 * h, 6 * h)).alias("p"))
    s1 = comm.where((F.col("p") > 0) & (F.col("c") > 5 * F.col("p"))).select("trend_id", F.lit("growth").alias("signal"), "source")
    dom = posts.where(within(t, now, 0.5 * h)).groupBy("trend_id", "host").agg(F.count("*").alias("c"), F.min("source").alias("source"))
    s2 = dom.where("c > 5").select("trend_id", F.lit("domain").alias("signal"), "source")
    sen = posts.where(within(t, now, 2 * h)).groupBy("trend_id", "source").agg(
        F.avg(F.when(span(h, 0), F.col("sentiment"))).alias("c"), F.avg(F.when(span(2 * h, h), F.col("sentiment"))).alias("p"))
    s3 = sen.where(F.abs(F.col("c") - F.col("p")) > 0.3).select("trend_id", F.lit("sentiment").alias("signal"), "source")
    per = s1.union(s2).union(s3).groupBy("trend_id").agg(
        F.count_distinct("signal").alias("signals"), F.count_distinct("source").alias("signal_sources"))
    odds = F.lit(math.log(prior / (1 - prior))) + F.col("signals") * F.lit(math.log(likelihood))
    return per.withColumn("posterior", sigmoid(odds)).withColumn(
        "confirmed", (F.col("signals") >= 2) & (F.col("signal_sources") >= 2) & (F.col("posterior") > 0.7))


def origin_quality(history: Column, engagement: Column, position: Column, authentic: Column, first: Column, corroborated: Column) -> Column:
    """Six weighted parts in 0..1."""
    return clamp01(0.25 * history + 0.20 * engagement + 0.20 * position + 0.15 * authentic + 0.10 * first + 0.10 * corroborated)


def origin_parts(mentions: DataFrame, ranks: DataFrame) -> DataFrame:
    """Parts of the origin quality per trend for its first author.

    ``ranks``: (author_id, rank) of the interaction graph, scaled here by the
    largest rank. History in topic: share of the author's posts in this trend.
    """
    key = F.struct("published_at", "external_id", "author_id", "source", "reach", "followers", "bot_score", "author_age_days")
    first = mentions.groupBy("trend_id").agg(F.min(key).alias("o"), F.bool_or(F.col("source").isin("gdelt", "reddit")).alias("corroborated"))
    o = first.select("trend_id", "corroborated", "o.author_id", "o.reach", "o.followers", "o.bot_score", "o.author_age_days")
    per = mentions.groupBy("trend_id", "author_id").agg(F.count("*").alias("here"))
    all_ = per.groupBy("author_id").agg(F.sum("here").alias("all"))
    top = ranks.agg(F.max("rank")).scalar()
    j = o.join(per, ["trend_id", "author_id"]).join(all_, "author_id").join(ranks, "author_id", "left")
    return j.select(
        "trend_id", "author_id", (F.col("here") / F.col("all")).alias("history"),
        F.least(F.lit(1.0), F.col("reach") / F.greatest(F.lit(1), F.col("followers"))).alias("engagement"),
        F.coalesce(F.col("rank") / top, F.lit(0.0)).alias("position"),
        ((1 - F.col("bot_score")) * F.least(F.lit(1.0), F.col("author_age_days") / 365.0)).alias("authentic"),
        F.lit(1.0).alias("first"), F.col("corroborated").cast("double").alias("corroborated"))
