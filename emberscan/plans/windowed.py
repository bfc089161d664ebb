"""Time series and the window score."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params
from ..functions.times import bucket, fmt, ts, within
from ..operators import score_window as sw
from ..operators import series
from .registry import query
from .views import mentions, now_of, sql

SIX_HOURS = 6 * 3600


def scores_6h(spark, sf):
    """Score series at a six-hour grain (the event table is thin)."""
    return series.trend_scores(mentions(spark, sf), SIX_HOURS)


def bucket_sql(col: str, seconds: int) -> str:
    return f"make_timestamp(CAST(floor(epoch_us({col}) / {seconds * 1_000_000}) * {seconds * 1_000_000} AS BIGINT))"


TS_SQL = f"""
, ts0 AS (SELECT trend_id, {bucket_sql('published_at', SIX_HOURS)} AS bucket_time, count(*) AS mention_count,
    avg(bot_score) AS bot, avg(sentiment) AS avg_sentiment FROM m GROUP BY ALL),
tsc AS (SELECT trend_id, bucket_time, mention_count, avg_sentiment, mention_count / 6.0 AS velocity,
    floor(100 * least(1.0, mention_count / 6.0 / 5.0) * (1 - bot) * 100 + 0.5) / 100 AS score,
    100 * (mention_count - lag(mention_count) OVER w) / nullif(CAST(lag(mention_count) OVER w AS DOUBLE), 0) AS delta_pct
  FROM ts0 WINDOW w AS (PARTITION BY trend_id ORDER BY bucket_time))"""


def window_sql(w: params.ScoreWindow) -> str:
    """CTEs ``inw`` (rows inside), ``cnt`` (dense buckets), ``ew`` (smoothed series)."""
    width = w.seconds / w.buckets
    return f"""
, inw AS (SELECT m.*, now, (epoch_us(now) - epoch_us(published_at)) / 1e6 AS age_s,
    CAST(least({w.buckets - 1}, greatest(0, floor(({w.seconds} - (epoch_us(now) - epoch_us(published_at)) / 1e6) / {width}))) AS BIGINT) AS b
  FROM m, p WHERE published_at > now - INTERVAL {w.hours} HOUR AND published_at <= now),
cnt AS (SELECT t.trend_id, i AS b, count(inw.external_id) AS n
  FROM (SELECT DISTINCT trend_id FROM inw) t CROSS JOIN range({w.buckets}) r(i)
  LEFT JOIN inw ON inw.trend_id = t.trend_id AND inw.b = i GROUP BY ALL),
ew AS (SELECT a.trend_id, a.b, sum({w.alpha} * pow(1 - {w.alpha}, a.b - c.b) * c.n / {w.bucket_hours}::DOUBLE) AS v
  FROM cnt a JOIN cnt c ON a.trend_id = c.trend_id AND c.b <= a.b GROUP BY ALL)"""


BASE_SQL = """
, dd AS (SELECT trend_id, CAST(floor((epoch_us(now) - epoch_us(published_at)) / 8.64e10) AS BIGINT) AS d FROM m, p
  WHERE published_at > now - INTERVAL 7 DAY),
dc AS (SELECT t.trend_id, i, count(dd.d) AS n FROM (SELECT DISTINCT trend_id FROM dd) t CROSS JOIN range(1, 7) r(i)
  LEFT JOIN dd ON dd.trend_id = t.trend_id AND dd.d = i GROUP BY ALL),
bl AS (SELECT trend_id, median(n) / 24.0 AS baseline FROM dc GROUP BY 1)"""


@query("a4_bucket_histogram", sql(window_sql(params.SCORE_WINDOWS["7D"]) + "SELECT trend_id, CAST(b AS INTEGER) AS bucket, n FROM cnt"))
def a4(spark, sf):
    return series.histogram(mentions(spark, sf), now_of(spark, sf), params.SCORE_WINDOWS["7D"])


def _ewma(key):
    def build(spark, sf):
        w = params.SCORE_WINDOWS[key]
        return series.bucket_counts(mentions(spark, sf), now_of(spark, sf), w).select(
            "trend_id", F.round(F.col("mentions") / F.lit(float(w.hours)), 6).alias("v_raw"),
            F.round(series.ewma(F.col("counts"), w), 6).alias("v_ewma"))

    return build


for _key in ("24H", "7D"):
    _w = params.SCORE_WINDOWS[_key]
    query(f"a5_a6_velocity_ewma_{_key.lower()}", sql(window_sql(_w) + f"""
SELECT trend_id, round(any_value(n) / {float(_w.hours)}, 6) AS v_raw, round(max(v) FILTER (b = {_w.buckets - 1}), 6) AS v_ewma
FROM ew JOIN (SELECT trend_id, count(*) AS n FROM inw GROUP BY 1) USING (trend_id) GROUP BY trend_id"""))(_ewma(_key))


@query("a6_ewma_series", sql(window_sql(params.SCORE_WINDOWS["24H"]) + "SELECT trend_id, CAST(b AS INTEGER) AS bucket, round(v, 6) AS v_ewma FROM ew"))
def a6(spark, sf):
    w = params.SCORE_WINDOWS["24H"]
    return series.bucket_counts(mentions(spark, sf), now_of(spark, sf), w).select(
        "trend_id", F.posexplode(series.ewma_series(F.col("counts"), w)).alias("bucket", "v")).select(
        "trend_id", "bucket", F.round("v", 6).alias("v_ewma"))


@query("a7_a8_baseline_delta", sql(window_sql(params.SCORE_WINDOWS["24H"]) + BASE_SQL + """
, v AS (SELECT trend_id, count(*) AS n, count(*) / 24.0 AS vel FROM inw GROUP BY 1)
SELECT trend_id, round(baseline, 6) AS baseline, CASE WHEN baseline <= 0 THEN CASE WHEN n >= 5 THEN 999 ELSE 0 END
  ELSE CAST(greatest(-999, least(999, floor(100 * (vel - baseline) / nullif(baseline, 0) + 0.5))) AS BIGINT) END AS delta
FROM v JOIN bl USING (trend_id)"""))
def a7(spark, sf):
    m, now = mentions(spark, sf), now_of(spark, sf)
    w = params.SCORE_WINDOWS["24H"]
    v = series.bucket_counts(m, now, w).select("trend_id", "mentions", (F.col("mentions") / 24.0).alias("v"))
    return v.join(series.daily_baseline(m, now), "trend_id").select(
        "trend_id", F.round("baseline", 6).alias("baseline"),
        series.delta_pct(F.col("v"), F.col("baseline"), F.col("mentions")).alias("delta"))


@query("a9_global_p95_sigma", sql(window_sql(params.SCORE_WINDOWS["7D"]) + """
, l AS (SELECT trend_id, max(v) FILTER (b = 27) AS v, stddev_pop(v) AS sigma FROM ew GROUP BY 1)
SELECT round(quantile_cont(v, 0.95), 6) AS p95, round(max(sigma), 6) AS max_sigma, round(avg(sigma), 6) AS avg_sigma FROM l"""))
def a9(spark, sf):
    w = params.SCORE_WINDOWS["7D"]
    s = series.bucket_counts(mentions(spark, sf), now_of(spark, sf), w).select(series.ewma_series(F.col("counts"), w).alias("e"))
    one = s.select(F.get("e", F.lit(27)).alias("v"), F.sqrt(series.variance_pop(F.col("e"))).alias("sigma"))
    return one.agg(F.round(F.percentile("v", F.lit(0.95)), 6).alias("p95"), F.round(F.max("sigma"), 6).alias("max_sigma"),
                   F.round(F.avg("sigma"), 6).alias("avg_sigma"))


@query("a17_mentions_1h", sql(f"""
SELECT strftime({bucket_sql('published_at', 3600)}, '%Y-%m-%d %H:%M:%S') AS bucket, trend_id, source, count(*) AS mention_count,
  count(DISTINCT author_id) AS unique_authors, round(avg(sentiment), 6) AS avg_sentiment, CAST(sum(coalesce(reach, 0)) AS BIGINT) AS total_reach
FROM m GROUP BY ALL"""))
def a17(spark, sf):
    return series.hourly_mentions(mentions(spark, sf)).withColumns(
        {"bucket": fmt(F.col("bucket")), "avg_sentiment": F.round("avg_sentiment", 6)})


@query("a18_mentions_source_1h", sql(f"""
SELECT strftime({bucket_sql('published_at', 3600)}, '%Y-%m-%d %H:%M:%S') AS bucket, source, count(*) AS mention_count,
  count(DISTINCT author_id) AS unique_authors FROM m GROUP BY ALL"""))
def a18(spark, sf):
    return series.hourly_mentions(mentions(spark, sf), with_trend=False).withColumn("bucket", fmt(F.col("bucket")))


@query("a19_score_downsample", sql(TS_SQL + f"""
SELECT trend_id, strftime({bucket_sql('bucket_time', 86400)}, '%Y-%m-%d %H:%M:%S') AS bucket, round(avg(score), 6) AS avg_score,
  round(max(score), 2) AS max_score, CAST(sum(mention_count) AS BIGINT) AS mentions, round(avg(delta_pct), 6) AS avg_delta
FROM tsc GROUP BY ALL"""))
def a19(spark, sf):
    return series.downsample(scores_6h(spark, sf), 86400).select(
        "trend_id", fmt(F.col("bucket")).alias("bucket"), F.round("avg_score", 6).alias("avg_score"),
        F.round("max_score", 2).alias("max_score"), "mentions", F.round("avg_delta", 6).alias("avg_delta"))


@query("a20_source_distribution", sql(f"""
, h AS (SELECT {bucket_sql('published_at', 3600)} AS bucket, source, count(*) AS mention_count, count(DISTINCT author_id) AS unique_authors FROM m GROUP BY ALL)
SELECT source, CAST(sum(mention_count) AS BIGINT) AS mention_count, CAST(sum(unique_authors) AS BIGINT) AS unique_authors,
  round(100.0 * sum(mention_count) / nullif(sum(sum(mention_count)) OVER (), 0), 2) AS pct
FROM h, p WHERE bucket >= now - INTERVAL 24 HOUR GROUP BY source"""))
def a20(spark, sf):
    return series.source_distribution(series.hourly_mentions(mentions(spark, sf), with_trend=False), now_of(spark, sf))


@query("w3_j6_versus_previous_24h", sql("""
, c AS (SELECT trend_id, count(*) FILTER (published_at >= now - INTERVAL 24 HOUR) AS cur,
    count(*) FILTER (published_at < now - INTERVAL 24 HOUR) AS prev,
    count(DISTINCT author_id) FILTER (published_at >= now - INTERVAL 24 HOUR) AS unique_authors,
    avg(sentiment) FILTER (published_at >= now - INTERVAL 24 HOUR) AS s
  FROM m, p WHERE published_at >= now - INTERVAL 48 HOUR GROUP BY 1)
SELECT trend_id, cur AS current, prev AS previous, cur - prev AS change, round((cur - prev) / nullif(prev, 0) * 100, 2) AS change_pct,
  unique_authors, round(s, 6) AS avg_sentiment FROM c"""))
def w3(spark, sf):
    return series.versus_previous(mentions(spark, sf), now_of(spark, sf), 86400.0).withColumn(
        "avg_sentiment", F.round("avg_sentiment", 6))


@query("w4_score_history", sql(TS_SQL + """
SELECT trend_id, strftime(bucket_time, '%Y-%m-%d %H:%M:%S') AS bucket, round(score, 2) AS score, mention_count AS mentions
FROM tsc, p WHERE bucket_time >= now - INTERVAL 7 DAY"""))
def w4(spark, sf):
    s = scores_6h(spark, sf).where(F.col("bucket_time") >= ts(now_of(spark, sf), -7 * 86400))
    return s.orderBy("trend_id", "bucket_time").select(
        "trend_id", fmt(F.col("bucket_time")).alias("bucket"), F.round("score", 2).alias("score"),
        F.col("mention_count").alias("mentions"))


@query("w5_normalised_series", sql("""
, q AS (SELECT trend_id, CAST(least(47, greatest(0, floor((604800 - (epoch_us(now) - epoch_us(published_at)) / 1e6) / 12600))) AS INTEGER) AS b
  FROM m, p WHERE published_at > now - INTERVAL 7 DAY AND published_at <= now),
c AS (SELECT t.trend_id, i AS point, count(q.b) AS n FROM (SELECT DISTINCT trend_id FROM q) t CROSS JOIN range(48) r(i)
  LEFT JOIN q ON q.trend_id = t.trend_id AND q.b = i GROUP BY ALL)
SELECT trend_id, CAST(point AS INTEGER) AS point, round(CASE WHEN max(n) OVER w > min(n) OVER w
  THEN (n - min(n) OVER w) / (max(n) OVER w - min(n) OVER w) ELSE 0 END, 6) AS value FROM c WINDOW w AS (PARTITION BY trend_id)"""))
def w5(spark, sf):
    return series.normalised_series(mentions(spark, sf), now_of(spark, sf), 168, params.SERIES_POINTS["7D"]).withColumn(
        "value", F.round("value", 6))


@query("w11_sliding_sum", sql("""
, c AS (SELECT trend_id, CAST(floor(epoch_us(published_at) / 60000000) AS BIGINT) AS minute, count(*) AS n FROM m GROUP BY ALL)
SELECT trend_id, minute, n, CAST(sum(n) OVER (PARTITION BY trend_id ORDER BY minute RANGE BETWEEN 359 PRECEDING AND CURRENT ROW) AS BIGINT) AS sliding FROM c"""))
def w11(spark, sf):
    return series.sliding_sum(mentions(spark, sf), 360)


# ---- window score --------------------------------------------------------------
def full(spark, sf, key="24H"):
    m, now = mentions(spark, sf), now_of(spark, sf)
    seen = m.where(within(F.col("published_at"), now, 30 * 86400) & (F.col("published_at") <= ts(now, -7 * 86400))
                   & (F.col("trend_id") <= "t4")).select("trend_id").distinct()
    return sw.compute_score(m, now, params.SCORE_WINDOWS[key], recycled=seen)


def full_sql(key: str) -> str:
    w = params.SCORE_WINDOWS[key]
    k, q, last = w.buckets, w.buckets // 4, w.buckets - 1
    dt = w.hours / 4.0
    return window_sql(w) + BASE_SQL + f"""
, ev AS (SELECT trend_id, count(*) FILTER (age < 2) AS p2, count(*) FILTER (age < 6) AS p6, count(*) FILTER (age < 24) AS p24
  FROM (SELECT trend_id, (epoch_us(now) - epoch_us(published_at)) / 3.6e9 AS age FROM m, p) GROUP BY 1),
rec AS (SELECT DISTINCT trend_id FROM m, p WHERE published_at > now - INTERVAL 30 DAY AND published_at <= now - INTERVAL 7 DAY AND trend_id <= 't4'),
f5 AS (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY published_at, external_id) AS rn FROM inw),
oq AS (SELECT trend_id, avg(coalesce(author_quality, 0.5)) AS origin_quality,
    max(CASE WHEN rn = 1 AND author_quality >= 0.5 THEN author_id END) AS originator FROM f5 WHERE rn <= 5 GROUP BY 1),
ag AS (SELECT trend_id, count(*) AS mentions, count(*) / {float(w.hours)} AS v_raw, count(DISTINCT author_id) AS unique_authors,
    count(DISTINCT source) AS unique_sources, count(DISTINCT coalesce(community, source)) AS unique_communities,
    count(DISTINCT CASE WHEN source IN ('rss', 'gdelt') THEN url END) AS media_sources, avg(bot_score) AS bot,
    coalesce(sum(author_quality * exp(-age_s / 21600) * sentiment) / nullif(sum(author_quality * exp(-age_s / 21600)), 0), 0) AS sentiment,
    max(published_at) AS last_seen FROM inw GROUP BY 1),
sl AS (SELECT trend_id, max(v) FILTER (b = {last}) AS v_ewma, stddev_pop(v) AS sigma,
    (max(v) FILTER (b = {last}) - max(v) FILTER (b = {last - q})) / {dt} AS short,
    (max(v) FILTER (b = {last - q}) - max(v) FILTER (b = {last - 2 * q})) / {dt} AS long,
    CASE WHEN avg(v) FILTER (b > {last - 6}) > 0 THEN var_pop(v) FILTER (b > {last - 6}) / avg(v) FILTER (b > {last - 6}) ELSE 0 END AS vr
  FROM ew GROUP BY 1),
en AS (SELECT trend_id, (log2(sum(n)) - sum(CASE WHEN n > 0 THEN n * log2(n) ELSE 0 END) / sum(n)) / log2({k}) AS h FROM cnt GROUP BY 1),
pk AS (SELECT trend_id, first(b ORDER BY n DESC, b) AS pb FROM cnt GROUP BY 1),
p95 AS (SELECT quantile_cont(v_ewma, 0.95) AS p95 FROM sl),
a AS (SELECT ag.*, p.now, origin_quality, originator, baseline, v_ewma, sigma, short, short - long AS accel, vr, h, p95, p2, p6, p24,
    (rec.trend_id IS NOT NULL) AS recycled,
    p.now - INTERVAL {w.hours} HOUR + to_microseconds(CAST(pb * {int(w.seconds / k * 1e6)} AS BIGINT)) AS peak_at,
    CASE WHEN baseline <= 0 THEN CASE WHEN mentions >= 5 THEN 999 ELSE 0 END
      ELSE CAST(greatest(-999, least(999, floor(100 * (v_raw - baseline) / nullif(baseline, 0) + 0.5))) AS BIGINT) END AS delta,
    CASE WHEN unique_authors / mentions < 0.4 THEN unique_authors / mentions / 0.4 ELSE 1 END AS p_spam, 1 - least(1, greatest(0, bot)) AS p_bot
  FROM ag JOIN oq USING (trend_id) JOIN bl USING (trend_id) JOIN sl USING (trend_id) JOIN en USING (trend_id) JOIN pk USING (trend_id)
    JOIN ev USING (trend_id) LEFT JOIN rec USING (trend_id), p95, p),
b AS (SELECT *, least(1, log10(1 + mentions) / log10(101)) AS s_volume, least(1, greatest(0, v_ewma / greatest(p95, 1e-6))) AS s_velocity,
    least(1, unique_authors / 14.0) AS s_breadth, least(1, unique_sources / 9.0) AS s_crosssrc, least(1, greatest(0, origin_quality)) AS s_origin,
    1 - h AS s_temporal, least(1, abs(delta) / 500.0) AS s_baseline, greatest(sigma, 1e-6) AS sg FROM a),
c AS (SELECT *, CAST(floor(100 * least(1, greatest(0, 0.22 * s_velocity + 0.20 * s_breadth + 0.18 * s_origin + 0.15 * s_crosssrc + 0.10 * s_baseline
      + 0.10 * s_volume + 0.05 * s_temporal)) * p_spam * p_bot * (CASE WHEN recycled THEN 0.3 ELSE 1 END) + 0.5) AS BIGINT) AS confidence,
    CASE WHEN vr > 1.5 AND abs(short) < 0.15 * sg THEN 'wobble' WHEN accel > 0.3 * sg AND short > 0 THEN 'accel'
      WHEN short > 0.2 * sg AND accel >= -0.1 * sg THEN 'rise' WHEN short < -0.3 * sg THEN 'decay' ELSE 'flat' END AS shape,
    CASE WHEN short > 0.05 * sg THEN 'up' WHEN short < -0.05 * sg THEN 'down' ELSE 'flat' END AS dir,
    least(1, greatest(0, 0.5 * s_velocity + 0.3 * s_baseline + 0.2 * s_origin)) * sqrt(p_spam * p_bot) AS heat_score FROM b),
e AS (SELECT *, CASE WHEN heat_score >= 0.85 THEN 'Muy caliente' WHEN heat_score >= 0.60 THEN 'Caliente' WHEN heat_score >= 0.30 THEN 'Templado' ELSE 'Enfriándose' END AS heat,
    CASE WHEN shape = 'accel' AND heat_score >= 0.6 THEN 'Crecimiento acelerado' WHEN shape = 'decay' THEN 'Interés en descenso'
      WHEN shape = 'wobble' AND heat_score < 0.5 THEN 'Señal débil'
      WHEN shape = 'rise' AND heat_score >= 0.45 AND unique_sources = 1 AND mentions < 40 THEN 'Rumor en crecimiento'
      WHEN shape = 'rise' AND heat_score >= 0.45 THEN 'Señal emergente' WHEN shape = 'accel' AND heat_score < 0.45 THEN 'Señal emergente'
      WHEN shape = 'flat' AND heat_score >= 0.3 THEN 'Actividad estable' WHEN shape = 'wobble' THEN 'Actividad inestable'
      WHEN heat_score < 0.3 THEN 'Señal débil' ELSE 'Actividad estable' END AS status,
    floor(sentiment * 10 + 0.5) / 10 AS s10 FROM c),
g AS (SELECT trend_id, unnest([
    {{'r': 100, 'l': 'Posts en ' || CASE shape WHEN 'accel' THEN '2h' WHEN 'rise' THEN '6h' WHEN 'wobble' THEN '6h' ELSE '24h' END,
      'v': CAST(CASE shape WHEN 'accel' THEN p2 WHEN 'rise' THEN p6 WHEN 'wobble' THEN p6 ELSE p24 END AS VARCHAR)}},
    {{'r': CASE WHEN unique_communities >= 2 THEN 90 END, 'l': 'Comunidades', 'v': CAST(unique_communities AS VARCHAR)}},
    {{'r': CASE WHEN media_sources = 0 THEN 80 ELSE 60 END, 'l': 'Medios', 'v': CAST(media_sources AS VARCHAR)}},
    {{'r': CASE WHEN originator IS NOT NULL THEN 70 END, 'l': 'Origen', 'v': CAST(originator AS VARCHAR)}},
    {{'r': CASE WHEN shape IN ('flat', 'wobble') THEN 75 END, 'l': 'Sentimiento', 'v': (CASE WHEN s10 >= 0 THEN '+' ELSE '' END) || printf('%.1f', s10)}},
    {{'r': CASE WHEN shape = 'decay' THEN 85 END, 'l': 'Pico', 'v': (CASE WHEN last_seen - peak_at < INTERVAL 24 HOUR THEN '' ELSE
       ['Dom','Lun','Mar','Mié','Jue','Vie','Sáb'][dayofweek(peak_at) + 1] || ' ' END) || strftime(peak_at, '%H:%M')}},
    {{'r': CASE WHEN unique_communities >= 3 THEN 50 END, 'l': 'Hilos activos', 'v': CAST(least(unique_communities, 12) AS VARCHAR)}},
    {{'r': CASE WHEN abs(delta) >= 200 THEN 65 END, 'l': 'Δ vs 7d', 'v': (CASE WHEN delta >= 0 THEN '+' ELSE '' END) || delta || '%'}},
    {{'r': 40, 'l': 'Fuentes', 'v': CAST(unique_sources AS VARCHAR)}}]) AS i FROM e),
g3 AS (SELECT trend_id, string_agg(i.l || '=' || i.v, ';' ORDER BY i.r DESC) AS evidence
  FROM (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY i.r DESC) AS rn FROM g WHERE i.r IS NOT NULL) WHERE rn <= 3 GROUP BY 1)"""


_PICK = """SELECT trend_id, mentions, CAST(floor(v_raw + 0.5) AS BIGINT) AS velocity, round(v_ewma, 6) AS v_ewma, delta, confidence,
  round(heat_score, 6) AS heat_score, heat, shape, dir, status, round(sentiment, 6) AS sentiment, CAST(originator AS VARCHAR) AS originator, evidence,
  array_to_string(list_filter([CASE WHEN delta >= 100 THEN '+' || delta || '% en la última ventana' WHEN delta <= -20 THEN delta || '% (perdiendo tracción)' END,
    CAST(floor(v_raw + 0.5) AS BIGINT) || ' menciones/h, ' || unique_authors || ' autores únicos',
    CASE WHEN unique_communities >= 3 THEN 'en ' || unique_communities || ' comunidades' END,
    CASE WHEN media_sources = 0 THEN 'sin cobertura mediática aún' ELSE media_sources || ' medio(s) recogiendo' END], lambda x: x IS NOT NULL), ', ') || '.' AS why
FROM e JOIN g3 USING (trend_id)"""


def _score(key):
    def build(spark, sf):
        return full(spark, sf, key).select(
            "trend_id", "mentions", "velocity", F.round("v_ewma", 6).alias("v_ewma"), "delta", "confidence",
            F.round("heat_score", 6).alias("heat_score"), "heat", "shape", "dir", "status",
            F.round("sentiment", 6).alias("sentiment"), F.col("originator").cast("string").alias("originator"),
            F.array_join(F.transform("evidence", lambda e: F.concat_ws("=", e["label"], e["value"])), ";").alias("evidence"), "why")

    return build


for _key in ("24H", "7D"):
    query(f"g18_compute_score_{_key.lower()}", sql(full_sql(_key) + _PICK))(_score(_key))


@query("g9_g10_g11_subscores_confidence", sql(full_sql("24H") + """
SELECT trend_id, round(s_volume, 6) AS s_volume, round(s_velocity, 6) AS s_velocity, round(s_breadth, 6) AS s_breadth, round(s_crosssrc, 6) AS s_crosssrc,
  round(s_origin, 6) AS s_origin, round(s_temporal, 6) AS s_temporal, round(s_baseline, 6) AS s_baseline, round(p_spam, 6) AS p_spam,
  round(p_bot, 6) AS p_bot, CAST(CASE WHEN recycled THEN 0.3 ELSE 1 END AS DOUBLE) AS p_recycle, confidence FROM e"""))
def g9(spark, sf):
    cols = ["s_volume", "s_velocity", "s_breadth", "s_crosssrc", "s_origin", "s_temporal", "s_baseline", "p_spam", "p_bot", "p_recycle"]
    return full(spark, sf).select("trend_id", *[F.round(c, 6).alias(c) for c in cols], "confidence")


@query("g12_g13_slopes_shape", sql(full_sql("7D") + """
SELECT trend_id, round(short, 6) AS slope_short, round(accel, 6) AS slope_accel, round(vr, 6) AS variance_ratio, round(sigma, 6) AS sigma, shape, dir FROM e"""))
def g12(spark, sf):
    return full(spark, sf, "7D").select(
        "trend_id", *[F.round(c, 6).alias(c) for c in ("slope_short", "slope_accel", "variance_ratio", "sigma")], "shape", "dir")


@query("g14_g15_heat_status", sql(full_sql("7D") + "SELECT trend_id, round(heat_score, 6) AS heat_score, heat, status FROM e"))
def g14(spark, sf):
    return full(spark, sf, "7D").select("trend_id", F.round("heat_score", 6).alias("heat_score"), "heat", "status")


@query("g16_g17_evidence_why", sql(full_sql("7D") + "SELECT trend_id, evidence FROM g3"))
def g16(spark, sf):
    return full(spark, sf, "7D").select(
        "trend_id", F.array_join(F.transform("evidence", lambda e: F.concat_ws("=", e["label"], e["value"])), ";").alias("evidence"))
