"""Counts, trailing windows and the early score."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params
from ..functions.times import fmt
from ..operators import profile as prof
from ..operators import score_early as early
from ..operators import series
from .registry import query
from .views import SCALE, TRAILING, mentions, now_of, sql


def profile(spark, sf):
    return prof.trend_profile(mentions(spark, sf), now_of(spark, sf), TRAILING)


def scored(spark, sf, kind=early.STRICT):
    """Trend rows with the early score. The base of most list queries."""
    if kind == early.RELAXED:
        base = prof.trend_profile(mentions(spark, sf), now_of(spark, sf), TRAILING, params.TRUST_RELAXED)
        return early.early_score(base, kind, tick_no=1)
    return early.early_score(profile(spark, sf), kind)


# SQL twins ------------------------------------------------------------------
TRUST_SQL = "CASE source " + " ".join(f"WHEN '{s}' THEN {v}" for s, v in params.TRUST_STRICT.items()) + " ELSE 0.5 END"
TRUST_RELAXED_SQL = "CASE source " + " ".join(f"WHEN '{s}' THEN {v}" for s, v in params.TRUST_RELAXED.items()) + " ELSE 0.5 END"


def profile_sql(trust: str = TRUST_SQL) -> str:
    """CTE ``pr``: the same columns as ``trend_profile``, written with DISTINCT."""
    h = SCALE * 3600.0
    age = "(epoch_us(now) - epoch_us(published_at)) / 1e6"
    return f"""
, r AS (
  SELECT m.*, now, {age} AS age_s,
    published_at > now - INTERVAL {SCALE * 15} MINUTE AS i15,
    published_at > now - INTERVAL {SCALE * 30} MINUTE AS i30,
    published_at > now - INTERVAL {SCALE * 60} MINUTE AS i60,
    published_at >= now - INTERVAL {SCALE * 60} MINUTE AS j60,
    published_at < now - INTERVAL {SCALE * 24} HOUR AS iold,
    CAST({trust} AS DOUBLE) AS trust1
  FROM m, p
),
au AS (SELECT trend_id, author_id, count(*) FILTER (j60) AS c60, count(*) AS n FROM r GROUP BY ALL),
so AS (SELECT trend_id, source, count(*) AS n, count(*) FILTER (i15) AS n15, count(*) FILTER (i60) AS n60,
         min(published_at) AS f FROM r GROUP BY ALL),
aux AS (SELECT trend_id, max(c60) AS max_author60, max(n) AS max_author FROM au GROUP BY 1),
sox AS (
  SELECT trend_id, max(n) AS max_source, max(n60) AS max_source60,
    count(*) FILTER (n15 > 0) AS k15, sum(n15) AS t15, count(*) AS k, sum(n) AS t,
    sum(CASE WHEN n15 > 0 THEN n15 * log2(n15) ELSE 0 END) AS x15, sum(n * log2(n)) AS x,
    coalesce(sum(n60) FILTER (source IN ('x','reddit','bluesky')), 0) AS social60,
    first(source ORDER BY n DESC, f) AS primary_source,
    string_agg(source, ',' ORDER BY source) AS sources
  FROM so GROUP BY 1
),
pr AS (
  SELECT r.trend_id, count(*) AS mentions, count(*) FILTER (i15) AS m15, count(*) FILTER (i30) AS m30,
    count(*) FILTER (i60) AS m60, count(*) FILTER (iold) AS older,
    count(DISTINCT author_id) AS unique_authors, count(DISTINCT author_id) FILTER (i60) AS authors60,
    count(DISTINCT source) AS unique_sources, count(DISTINCT source) FILTER (i60) AS sources60,
    count(DISTINCT source) FILTER (i15) AS sources15,
    any_value(max_author60) AS max_author60, any_value(max_author) AS max_author,
    any_value(max_source) AS max_source, any_value(max_source60) AS max_source60,
    any_value(social60) AS social60, any_value(primary_source) AS primary_source, any_value(sources) AS sources,
    sum(exp(-ln(2) / 6 * greatest(0, age_s / {h}))) AS weighted_volume,
    avg(exp(-ln(2) / 6 * greatest(0, age_s / {h}))) AS freshness,
    avg(trust1) AS trust,
    any_value(CASE WHEN k15 > 1 THEN least(1, (log2(t15) - x15 / t15) / log2(k15)) ELSE 0 END) AS entropy15,
    any_value(CASE WHEN k > 1 THEN least(1, (log2(t) - x / t) / log2(k)) ELSE 0 END) AS entropy_all,
    min(published_at) AS first_seen, max(published_at) AS last_seen,
    max(age_s) / {h} AS age_hours, min(age_s) / {h} AS idle_hours
  FROM r JOIN aux USING (trend_id) JOIN sox USING (trend_id) GROUP BY r.trend_id
)"""


def score_sql(kind: str = early.STRICT) -> str:
    """CTE ``sc``: the early score over ``pr``."""
    strict = kind == early.STRICT
    if strict:
        eff = "velocity AS ev, is_new AS en, ratio AS er"
        ent, fresh = "entropy15", "least(1, freshness)"
        gates = """
g1 AS (SELECT *, CASE WHEN m30 = 0 THEN least(raw_score, 5) ELSE raw_score END AS s1 FROM raw),
g2 AS (SELECT *, CASE WHEN m60 = 0 THEN 0 ELSE s1 END AS s2 FROM g1),
g3 AS (SELECT *, CASE WHEN mentions = 1 THEN least(s2, 15) ELSE s2 END AS s3 FROM g2),
g4 AS (SELECT *, CASE WHEN s3 >= 50 AND (m15 < 2 OR sources60 < 2) THEN least(s3, 49) ELSE s3 END AS s4 FROM g3),
g5 AS (SELECT *, CASE WHEN s4 >= 70 AND ((NOT en AND er < 1.5) OR sources60 < 3) THEN least(s4, 69) ELSE s4 END AS gated_score FROM g4)"""
    else:
        est = "mentions / greatest(5.0, age_hours * 60)"
        boost = f"(mentions > 0 AND velocity < {est})"
        eff = (f"CASE WHEN {boost} THEN greatest(velocity, {est} * 0.5) ELSE velocity END AS ev, "
               f"CASE WHEN {boost} THEN false ELSE is_new END AS en, CASE WHEN {boost} THEN 1.5 ELSE ratio END AS er")
        ent, fresh = "entropy_all", "least(1, exp(-idle_hours / 6))"
        gates = """
g1 AS (SELECT *, CASE WHEN m60 = 0 THEN least(raw_score, 10) ELSE raw_score END AS s1 FROM raw),
g2 AS (SELECT *, CASE WHEN m30 = 0 AND m60 > 0 THEN least(s1, 25) ELSE s1 END AS s2 FROM g1),
g3 AS (SELECT *, CASE WHEN mentions = 1 THEN least(s2, 20) ELSE s2 END AS s3 FROM g2),
g4 AS (SELECT *, CASE WHEN s3 >= 25 AND m60 < 2 THEN least(s3, 24) ELSE s3 END AS s4 FROM g3),
g5 AS (SELECT *, CASE WHEN s4 >= 60 AND ((NOT en AND er < 1.2) OR sources60 < 2) THEN least(s4, 59) ELSE s4 END AS gated_score FROM g4)"""
    return f"""
, mo AS (
  SELECT *, m15 / 15.0 AS velocity, m60 / 60.0 AS velocity60, m15 / 15.0 - m60 / 60.0 AS acceleration,
    m60 = 0 AND m15 > 0 AS is_new,
    CASE WHEN m60 > 0 THEN (m15 / 15.0) / (m60 / 60.0) WHEN m15 > 0 THEN NULL ELSE 0 END AS ratio,
    CASE WHEN max_author60 > 14 THEN 0.4 ELSE 0 END AS p_spam,
    CASE WHEN m60 > 2 AND max_author60 / greatest(1, m60) > 0.5 THEN 0.4 ELSE 0 END AS p_bot,
    CASE WHEN older / greatest(1, mentions) > 0.3 THEN 0.3 ELSE 0 END AS p_recycle
  FROM pr
),
ef AS (SELECT *, {eff}, CAST(least(1, p_spam + p_bot + p_recycle) AS DOUBLE) AS penalty FROM mo),
raw AS (
  SELECT *, floor((0.30 * least(1, ev / 5) + 0.25 * (CASE WHEN en THEN 1.0 WHEN er >= 2 THEN 1.0
      WHEN er >= 1 THEN 0.5 + (er - 1) * 0.5 WHEN er >= 0.5 THEN 0.2 + (er - 0.5) * 0.6 ELSE greatest(0, er * 0.4) END)
    + 0.15 * least(1, sources60 / 3) + 0.08 * {ent}
    + 0.10 * (CASE WHEN m60 > 0 THEN least(1, authors60 / m60) WHEN m15 > 0 THEN 0.5 ELSE 0 END)
    + 0.07 * {fresh} + 0.05 * trust) * (1 - penalty) * 100 * 100 + 0.5) / 100 AS raw_score
  FROM ef
),{gates},
qu AS (
  SELECT *, CASE WHEN m60 > 0 THEN max_source60 / m60 ELSE 0 END AS source_share, social60 > 0 AS has_social FROM g5
),
sc0 AS (
  SELECT *, CASE WHEN source_share > 0.35 AND NOT has_social
      THEN floor(gated_score * (1 - least(0.5, (source_share - 0.35) * 1.5)) * 100 + 0.5) / 100 ELSE gated_score END AS score,
    CASE WHEN is_new AND acceleration > 0 THEN 'accel' WHEN ratio >= 2 AND acceleration > 0 THEN 'accel'
      WHEN acceleration > 0.05 AND (is_new OR ratio >= 1.2) THEN 'rise'
      WHEN acceleration < -0.05 OR (NOT is_new AND ratio > 0 AND ratio < 0.5) THEN 'decay' ELSE 'flat' END AS shape
  FROM qu
),
sc AS (
  SELECT *, score >= 35 AND m60 >= 2 AND m30 >= 1 AND (has_social OR source_share <= 0.5) AS is_trending,
    CASE WHEN age_hours < 2 AND m15 >= 2 AND acceleration > 0 AND sources15 >= 2 THEN 'rising'
      WHEN ev > 0.3 AND m60 >= 5 AND shape <> 'decay' THEN 'peaked'
      WHEN shape = 'decay' OR m15 = 0 THEN 'decaying' ELSE 'forming' END AS phase
  FROM sc0
)"""


TRENDS = profile_sql() + score_sql()


@query("a1_base_counts", sql("""
SELECT trend_id, count(*) AS mentions, count(DISTINCT author_id) AS unique_authors,
  count(DISTINCT source) AS unique_sources, count(DISTINCT coalesce(community, source)) AS unique_communities,
  count(DISTINCT CASE WHEN source IN ('rss', 'gdelt') THEN url END) AS media_urls
FROM m GROUP BY trend_id"""))
def a1(spark, sf):
    return prof.base_counts(mentions(spark, sf))


@query("a2_trailing_windows", sql(profile_sql() + """
SELECT trend_id, mentions, CAST(m15 AS BIGINT) AS m15, m30, m60, older, unique_authors, authors60, unique_sources, sources60, sources15,
  strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM pr"""))
def a2(spark, sf):
    return profile(spark, sf).select(
        "trend_id", "mentions", "m15", "m30", "m60", "older", "unique_authors", "authors60", "unique_sources",
        "sources60", "sources15", fmt(F.col("first_seen")).alias("first_seen"), fmt(F.col("last_seen")).alias("last_seen"))


@query("a3_source_counts", sql("""
SELECT trend_id, source, count(m.external_id) AS mentions
FROM (SELECT DISTINCT trend_id FROM m) t CROSS JOIN (SELECT unnest(['reddit','bluesky','hn','rss','gdelt','github','x']) AS source) s
LEFT JOIN m USING (trend_id, source) GROUP BY ALL"""))
def a3(spark, sf):
    return prof.source_counts(mentions(spark, sf))


@query("a5_velocity_per_minute", sql(profile_sql() + """
SELECT trend_id, round(m15 / 15.0, 6) AS velocity15, round(m60 / 60.0, 6) AS velocity60 FROM pr"""))
def a5(spark, sf):
    return early.with_motion(profile(spark, sf)).select(
        "trend_id", F.round("velocity", 6).alias("velocity15"), F.round("velocity60", 6).alias("velocity60"))


@query("a10_entropy", sql(profile_sql() + """
SELECT trend_id, round(entropy15, 6) AS entropy_recent, round(entropy_all, 6) AS entropy_all FROM pr"""))
def a10(spark, sf):
    return profile(spark, sf).select(
        "trend_id", F.round("entropy15", 6).alias("entropy_recent"), F.round("entropy_all", 6).alias("entropy_all"))


@query("a11_decay_volume", sql(profile_sql() + """
SELECT trend_id, round(weighted_volume, 6) AS weighted_volume, round(freshness, 6) AS freshness,
  round(exp(-idle_hours / 6), 6) AS last_seen_freshness FROM pr"""))
def a11(spark, sf):
    return profile(spark, sf).select(
        "trend_id", F.round("weighted_volume", 6).alias("weighted_volume"), F.round("freshness", 6).alias("freshness"),
        F.round(F.exp(-F.col("idle_hours") / 6), 6).alias("last_seen_freshness"))


@query("a12_weighted_sentiment", sql("""
SELECT trend_id, round(coalesce(sum(w * sentiment) / nullif(sum(w), 0), 0), 6) AS sentiment
FROM (SELECT trend_id, sentiment, coalesce(author_quality, 0.5) * exp(-(epoch_us(now) - epoch_us(published_at)) / 3.6e9 / 6) AS w FROM m, p)
GROUP BY trend_id"""))
def a12(spark, sf):
    return prof.weighted_sentiment(mentions(spark, sf), now_of(spark, sf)).select(
        "trend_id", F.round("sentiment", 6).alias("sentiment"))


@query("a13_source_trust", sql(f"""
SELECT trend_id, round(avg(CAST({TRUST_SQL} AS DOUBLE)), 6) AS trust_strict,
  round(avg(CAST({TRUST_RELAXED_SQL} AS DOUBLE)), 6) AS trust_relaxed FROM m GROUP BY trend_id"""))
def a13(spark, sf):
    return mentions(spark, sf).groupBy("trend_id").agg(
        F.round(F.avg(prof.lookup(F.col("source"), params.TRUST_STRICT, 0.5)), 6).alias("trust_strict"),
        F.round(F.avg(prof.lookup(F.col("source"), params.TRUST_RELAXED, 0.5)), 6).alias("trust_relaxed"))


@query("a14_top_author_share", sql(profile_sql() + """
SELECT r.trend_id, any_value(max_author60) AS max_author60, count(*) FILTER (i60) AS m60,
  round(any_value(max_author60) / greatest(1, count(*) FILTER (i60)), 6) AS author_share
FROM r JOIN aux USING (trend_id) GROUP BY 1 HAVING count(*) FILTER (j60) > 0"""))
def a14(spark, sf):
    return prof.top_author_share(mentions(spark, sf), now_of(spark, sf), TRAILING).withColumn(
        "author_share", F.round("author_share", 6))


@query("a15_recycle_ratio", sql("""
SELECT trend_id, round(avg(CASE WHEN published_at < now - INTERVAL 24 HOUR THEN 1 ELSE 0 END), 6) AS old_ratio_24h,
  round(avg(CASE WHEN published_at < now - INTERVAL 20 DAY THEN 1 ELSE 0 END), 6) AS old_ratio_20d
FROM m, p GROUP BY trend_id"""))
def a15(spark, sf):
    now = now_of(spark, sf)
    a = prof.recycle_ratio(mentions(spark, sf), now).select("trend_id", F.round("old_ratio", 6).alias("old_ratio_24h"))
    b = prof.recycle_ratio(mentions(spark, sf), now, 20 * 86400.0).select("trend_id", F.round("old_ratio", 6).alias("old_ratio_20d"))
    return a.join(b, "trend_id")


@query("a16_source_mix", sql(profile_sql() + """
SELECT trend_id, round(CASE WHEN m60 > 0 THEN max_source60 / m60 ELSE 0 END, 6) AS share60,
  round(CASE WHEN m60 > 0 THEN max_source / m60 ELSE 0 END, 6) AS share_mixed, social60 > 0 AS has_social FROM pr"""))
def a16(spark, sf):
    return prof.source_mix(mentions(spark, sf), now_of(spark, sf), TRAILING).select(
        "trend_id", F.round("share60", 6).alias("share60"), F.round("share_mixed", 6).alias("share_mixed"), "has_social")


@query("a30_author_quality", sql("""
SELECT author_id, round(min(q), 6) AS quality, round(max(CASE WHEN source = 'rss' THEN 0.6 ELSE q END), 6) AS quality_or_institution
FROM (SELECT author_id, source, least(1, greatest(0, 0.5 + 0.2 * CAST(verified AS INT) + 0.2 * least(1, author_age_days / 365.0)
   + 0.1 * least(1, log10(1 + followers) / 5) - 0.5 * bot_score)) AS q FROM m) GROUP BY author_id"""))
def a30(spark, sf):
    m = mentions(spark, sf)
    q = lambda inst: prof.author_quality(
        F.col("verified"), F.col("author_age_days"), F.col("followers"), F.col("bot_score"), inst)
    return m.groupBy("author_id").agg(
        F.round(F.min(q(F.lit(False))), 6).alias("quality"),
        F.round(F.max(q(F.col("source") == "rss")), 6).alias("quality_or_institution"))


@query("a31_c5_origin_quality", sql("""
, f AS (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY published_at, external_id) AS rn FROM m)
SELECT trend_id, round(avg(coalesce(author_quality, 0.5)), 6) AS origin_quality,
  max(CASE WHEN rn = 1 AND author_quality >= 0.5 THEN author_id END) AS originator
FROM f WHERE rn <= 5 GROUP BY trend_id"""))
def a31(spark, sf):
    return prof.origin_quality_first5(mentions(spark, sf)).withColumn("origin_quality", F.round("origin_quality", 6))


@query("g1_g2_g3_early_score_strict", sql(TRENDS + """
SELECT trend_id, round(raw_score, 2) AS raw_score, round(gated_score, 2) AS gated_score, round(score, 2) AS score, is_trending FROM sc"""))
def g1(spark, sf):
    return scored(spark, sf).select(
        "trend_id", F.round("raw_score", 2).alias("raw_score"), F.round("gated_score", 2).alias("gated_score"),
        F.round("score", 2).alias("score"), "is_trending")


@query("g2_g4_early_score_relaxed", sql(profile_sql(TRUST_RELAXED_SQL) + score_sql(early.RELAXED) + """
SELECT trend_id, round(ev, 6) AS eff_velocity, round(raw_score, 2) AS raw_score, round(gated_score, 2) AS gated_score,
  round(score, 2) AS score, is_trending, phase FROM sc"""))
def g4(spark, sf):
    return scored(spark, sf, early.RELAXED).select(
        "trend_id", F.round("eff_velocity", 6).alias("eff_velocity"), F.round("raw_score", 2).alias("raw_score"),
        F.round("gated_score", 2).alias("gated_score"), F.round("score", 2).alias("score"), "is_trending", "phase")


@query("g5_g6_shape_phase", sql(TRENDS + "SELECT trend_id, shape, phase, round(acceleration, 6) AS acceleration FROM sc"))
def g5(spark, sf):
    return scored(spark, sf).select("trend_id", "shape", "phase", F.round("acceleration", 6).alias("acceleration"))


def _by_author(spark, sf):
    """Mentions with each author of a source as a trend: few posts, in bursts."""
    return mentions(spark, sf).withColumn("trend_id", F.concat_ws("/", "source", F.col("author_id").cast("string")))


@query("g5_shape_with_history", sql(", mk AS (SELECT * REPLACE (source || '/' || author_id AS trend_id) FROM m)" + profile_sql().replace("FROM m, p", "FROM mk m, p") + score_sql() + f"""
, b AS (SELECT trend_id, CAST(floor((epoch_us(now) - epoch_us(published_at)) / {SCALE * 9e8}) AS BIGINT) AS back FROM mk, p),
u AS (SELECT trend_id, unnest(range(0, least(max(back), 11) + 1)) AS back FROM b GROUP BY 1),
h AS (SELECT u.trend_id, u.back, count(b.back) AS n FROM u LEFT JOIN b ON b.trend_id = u.trend_id AND b.back = u.back GROUP BY ALL),
v AS (SELECT trend_id, count(*) AS k, sum(n) AS s, sum(n * n) AS q FROM h GROUP BY 1)
SELECT trend_id, CASE WHEN shape = 'flat' AND k >= 5 AND abs(acceleration) < 0.05 AND 2 * (k * q - s * s) > s * s + k * k THEN 'wobble' ELSE shape END AS shape, phase
FROM sc JOIN v USING (trend_id)"""))
def g5h(spark, sf):
    """Shapes with the counts of the last twelve short windows, so that a swinging trend wobbles."""
    m, now = _by_author(spark, sf), now_of(spark, sf)
    rows = prof.trend_profile(m, now, TRAILING).join(series.recent_counts(m, now, SCALE * 900), "trend_id")
    return early.early_score(rows, history="history").select("trend_id", "shape", "phase")


@query("g7_penalties", sql(TRENDS + """
SELECT trend_id, round(CAST(least(1, p_spam + CASE WHEN unique_authors / mentions < 0.4 THEN 0.3 ELSE 0 END
    + CASE WHEN older / mentions > 0.3 THEN 0.3 ELSE 0 END) AS DOUBLE), 2) AS penalty_authors,
  round(penalty, 2) AS penalty_dominance FROM sc"""))
def g7(spark, sf):
    both = early.penalty_dominance(
        early.penalty_authors(profile(spark, sf)).withColumnRenamed("penalty", "penalty_a"))
    return both.select("trend_id", F.round("penalty_a", 2).alias("penalty_authors"),
                       F.round("penalty", 2).alias("penalty_dominance"))


@query("c10_listing", sql(TRENDS + """
, day AS (SELECT * FROM sc, p WHERE last_seen > p.now - INTERVAL 24 HOUR)
SELECT 'trending' AS listing, trend_id, round(score, 2) AS score FROM (SELECT * FROM day WHERE score > 0 ORDER BY score DESC, trend_id LIMIT 20)
UNION ALL
SELECT 'all', trend_id, round(score, 2) FROM (SELECT * FROM day ORDER BY last_seen DESC, trend_id LIMIT 50)"""))
def c10(spark, sf):
    from ..operators.views import all_recent, trending

    s, now = scored(spark, sf), now_of(spark, sf)
    pick = ["trend_id", F.round("score", 2).alias("score")]
    a = trending(s, now, 20).select(F.lit("trending").alias("listing"), *pick)
    return a.unionByName(all_recent(s, now, 50).select(F.lit("all").alias("listing"), *pick))


@query("w2_top_active", sql(TRENDS + """
SELECT trend_id, round(score, 2) AS score, mentions, shape FROM sc, p
WHERE score > 0 AND last_seen >= p.now - INTERVAL 6 HOUR ORDER BY score DESC, trend_id LIMIT 6"""))
def w2(spark, sf):
    from ..functions.times import ts

    s = scored(spark, sf)
    return (s.where((F.col("score") > 0) & (F.col("last_seen") >= ts(now_of(spark, sf), -6 * 3600)))
            .orderBy(F.desc("score"), "trend_id").limit(6)
            .select("trend_id", F.round("score", 2).alias("score"), "mentions", "shape"))
