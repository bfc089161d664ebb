"""Reports, evaluation, trust, alerts, search and table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params
from ..functions import text as tx
from ..functions.numeric import entropy, ordered_mean, xlog2x
from ..functions.times import fmt, micros, ts
from ..operators import alerts, graph, joins, profile as prof, reports, score_early as early, search, series, tables, trust, views
from .derived import RULES_SQL, SAVED_SQL, STEP, TICKS, TREND_ROWS, posts_full, rules, saved, ticks
from .early import TRENDS, profile, profile_sql, scored
from .lists import VIEW, view
from .registry import query
from .views import SCALE, documents, mentions, now_of, posts, posts_sql, sql, table, text_hashes, texts
from .text import normalise_sql
from .windowed import TS_SQL, bucket_sql, scores_6h

FMT = "'%Y-%m-%d %H:%M:%S'"


# ---- reports -----------------------------------------------------------------------------
@query("a21_unique_authors_hll", sql(f"""
SELECT trend_id, count(DISTINCT author_id) AS exact, true AS within_five_percent FROM m, p
WHERE {bucket_sql('published_at', 3600)} > now - INTERVAL 24 DAY GROUP BY 1"""))
def a21(spark, sf):
    """Sketch estimate checked against the exact count over the same hours."""
    m, now = mentions(spark, sf), now_of(spark, sf)
    est = reports.unique_authors_estimate(reports.unique_authors_sketch(m), now, 24 * 24)
    from ..functions.times import bucket

    exact = m.where(bucket(F.col("published_at"), 3600) > ts(now, -24 * 86400)).groupBy("trend_id").agg(F.count_distinct("author_id").alias("exact"))
    return exact.join(est, "trend_id").select("trend_id", "exact", (F.abs(F.col("unique_authors") - F.col("exact")) <= 0.05 * F.col("exact")).alias("within_five_percent"))


@query("a22_engine_stats_daily", sql("""
SELECT strftime(published_at, '%Y-%m-%d') AS stat_date, source AS engine, count(*) AS analyzed, count(*) FILTER (external_id % 6 = 0) AS errors,
  round(avg(reach), 6) AS avg_latency, max(reach) AS max_latency, round(quantile_cont(reach, 0.95), 6) AS p95_latency, round(quantile_cont(reach, 0.99), 6) AS p99_latency,
  round(count(*) / 86400.0, 8) AS qps FROM m GROUP BY ALL"""))
def a22(spark, sf):
    runs = mentions(spark, sf).select(F.col("source").alias("engine"), F.col("published_at").alias("at"), F.col("reach").alias("latency_ms"), (F.col("external_id") % 6 != 0).alias("ok"))
    return reports.engine_stats_daily(runs).select(
        F.date_format("stat_date", "yyyy-MM-dd").alias("stat_date"), "engine", "analyzed", "errors", F.round("avg_latency", 6).alias("avg_latency"), "max_latency",
        F.round("p95_latency", 6).alias("p95_latency"), F.round("p99_latency", 6).alias("p99_latency"), F.round("qps", 8).alias("qps"))


@query("a23_ingest_stats", sql(f"""
, k AS (SELECT {bucket_sql('published_at', 86400)} AS tick, count(DISTINCT doc_id) AS unique_hashes FROM m GROUP BY 1),
g AS (SELECT tick, unique_hashes, s.source, count(m.external_id) AS items FROM k CROSS JOIN (SELECT unnest(['reddit','bluesky','hn','rss','gdelt','github','x']) AS source) s
  LEFT JOIN m ON m.source = s.source AND {bucket_sql('m.published_at', 86400)} = tick GROUP BY ALL)
SELECT strftime(tick, {FMT}) AS tick, unique_hashes, source, items, CASE WHEN items > 0 THEN 'online' WHEN source IN ('gdelt', 'x') THEN 'degraded' ELSE 'offline' END AS health,
  CAST(sum(items) OVER (PARTITION BY source ORDER BY tick) AS BIGINT) AS total FROM g"""))
def a23(spark, sf):
    return reports.ingest_stats(mentions(spark, sf), 86400, ["gdelt", "x"]).withColumn("tick", fmt(F.col("tick")))


@query("a24_report_kpis", sql(TRENDS + """
SELECT CASE grouping_id(primary_source, phase) WHEN 3 THEN 'all' WHEN 1 THEN 'source' ELSE 'phase' END AS level, coalesce(primary_source, phase, 'all') AS value,
  count(*) AS clusters, CAST(sum(mentions) AS BIGINT) AS mentions, round(max(score), 2) AS top_score, round(avg(score), 6) AS avg_score
FROM sc, p WHERE last_seen > p.now - INTERVAL 6 HOUR GROUP BY GROUPING SETS ((primary_source), (phase), ())"""))
def a24(spark, sf):
    return reports.report_kpis(scored(spark, sf), ts(now_of(spark, sf), -6 * 3600)).withColumns(
        {"top_score": F.round("top_score", 2), "avg_score": F.round("avg_score", 6)})


@query("a25_period_report", sql("""
, f AS (SELECT trend_id, community, min(epoch_us(published_at)) AS f FROM m GROUP BY ALL),
md AS (SELECT trend_id, min(epoch_us(published_at)) AS a, max(epoch_us(published_at)) AS b FROM m WHERE source IN ('rss', 'gdelt') GROUP BY 1),
s AS (SELECT CAST(floor((epoch_us(now) - f) / 6.048e11) AS BIGINT) AS periods_back, b > f AS conf, CASE WHEN a > f THEN (a - f) / 3.6e9 END AS lead FROM f LEFT JOIN md USING (trend_id), p),
g AS (SELECT periods_back, count(*) AS detected, count(*) FILTER (conf) AS confirmed, avg(lead) AS lead FROM s GROUP BY 1),
w AS (SELECT *, lag(detected) OVER (ORDER BY periods_back DESC) AS detected_prev FROM g)
SELECT periods_back, detected, confirmed, round(100.0 * confirmed / detected, 6) AS accuracy, round(lead, 6) AS lead_hours, detected_prev,
  round(100.0 * (detected - detected_prev) / detected_prev, 6) AS change_pct FROM w"""))
def a25(spark, sf):
    return reports.period_report(mentions(spark, sf), now_of(spark, sf), 7, 100).withColumns(
        {c: F.round(c, 6) for c in ("accuracy", "lead_hours", "change_pct")})


@query("a25_sources_by_period", sql("""
, f AS (SELECT trend_id, community, min((epoch_us(published_at), external_id, source)) AS f FROM m GROUP BY ALL),
s AS (SELECT CAST(floor((epoch_us(now) - f[1]) / 6.048e11) AS BIGINT) AS periods_back, f[3] AS source, count(*) AS detected FROM f, p GROUP BY ALL)
SELECT *, round(100.0 * detected / sum(detected) OVER (PARTITION BY periods_back), 6) AS pct FROM s"""))
def a25s(spark, sf):
    return reports.period_sources(mentions(spark, sf), now_of(spark, sf), 7).withColumn("pct", F.round("pct", 6))


@query("a25_top_delta", sql("""
, n AS (SELECT trend_id, CAST(floor((epoch_us(now) - epoch_us(published_at)) / 6.048e11) AS BIGINT) AS periods_back, count(*) AS c FROM m, p GROUP BY ALL),
d AS (SELECT n.trend_id, n.periods_back, round(100.0 * (n.c - b.c) / b.c, 6) AS delta_pct FROM n JOIN n b ON b.trend_id = n.trend_id AND b.periods_back = n.periods_back + 1)
SELECT periods_back, first(trend_id ORDER BY delta_pct DESC, trend_id) AS trend_id, max(delta_pct) AS delta_pct FROM d GROUP BY 1"""))
def a25d(spark, sf):
    return reports.period_top_delta(mentions(spark, sf), now_of(spark, sf), 7)


@query("a25_detections_by_hour", sql("""
, f AS (SELECT min(published_at) AS f FROM m GROUP BY trend_id, community)
SELECT CAST(h AS INTEGER) AS hour, count(f) AS detected FROM range(24) r(h) LEFT JOIN f ON hour(f) = h GROUP BY 1"""))
def a25h(spark, sf):
    return reports.detections_by_hour(mentions(spark, sf))


@query("a26_lead_time", sql("""
SELECT community AS trend_id, min(epoch_us(published_at)) AS first_us, min(CASE WHEN source IN ('rss', 'gdelt') THEN epoch_us(published_at) END) AS media_us,
  round((min(CASE WHEN source IN ('rss', 'gdelt') THEN epoch_us(published_at) END) - min(epoch_us(published_at))) / 1e6, 3) AS lead_seconds
FROM (SELECT *  REPLACE (split_part(community, '/', 2) AS community) FROM m) GROUP BY 1"""))
def a26(spark, sf):
    m = mentions(spark, sf).withColumn("trend_id", F.get(F.split("community", "/"), F.lit(1)))
    return reports.lead_times(m).withColumn("lead_seconds", F.round("lead_seconds", 3))


@query("a27_spread_order", sql(f"""
, s AS (SELECT trend_id, source, min(published_at) AS f FROM m GROUP BY ALL)
SELECT trend_id, source, strftime(f, {FMT}) AS first_seen, CAST(row_number() OVER w AS INTEGER) AS ord, round((epoch_us(f) - lag(epoch_us(f)) OVER w) / 1e6, 3) AS gap_seconds,
  sum(CASE WHEN f > now - INTERVAL 720 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY trend_id) >= 2 AS spreading_fast FROM s, p WINDOW w AS (PARTITION BY trend_id ORDER BY f, source)"""))
def a27(spark, sf):
    return reports.spread_order(mentions(spark, sf), now_of(spark, sf), 720 * 3600.0).withColumns(
        {"first_seen": fmt(F.col("first_seen")), "gap_seconds": F.round("gap_seconds", 3)})


@query("a28_source_panel", sql("""
, c AS (SELECT trend_id, source, count(*) FILTER (published_at > now - INTERVAL 48 HOUR) AS mentions, count(*) FILTER (published_at <= now - INTERVAL 48 HOUR) AS previous
  FROM m, p WHERE published_at > now - INTERVAL 96 HOUR GROUP BY ALL)
SELECT *, round((mentions - previous) / nullif(previous, 0) * 100, 2) AS growth_pct FROM c"""))
def a28(spark, sf):
    return reports.source_panel(mentions(spark, sf), now_of(spark, sf), 48 * 3600.0)


@query("a29_dashboard", sql(TRENDS + "SELECT count(*) FILTER (phase IN ('forming', 'rising')) AS emerging, count(*) FILTER (score >= 20 AND score < 50) AS weak, count(*) AS trends FROM sc"))
def a29(spark, sf):
    return reports.dashboard(scored(spark, sf))


@query("a29_saved_counts", sql(TRENDS + SAVED_SQL + """
SELECT CASE WHEN grouping(folder) = 1 THEN '(all)' ELSE coalesce(folder, '(none)') END AS folder, count(*) AS n, count(*) FILTER (pinned) AS pinned,
  count(*) FILTER (coalesce(folder, '') = '') AS none FROM saved JOIN sc USING (trend_id) GROUP BY ROLLUP (folder)"""))
def a29s(spark, sf):
    return reports.saved_counts(saved(spark).join(scored(spark, sf), "trend_id"))


@query("a32_pivot", """
, o AS (SELECT o_orderpriority, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT DISTINCT o_orderpriority FROM o)
SELECT o_orderpriority, """.replace(", o AS", "WITH o AS", 1) + ", ".join(
    f"round(coalesce(sum(o_totalprice) FILTER (c_mktsegment = '{v}'), 0), 2) AS \"{v}_o_totalprice_sum\", "
    f"round(CAST(count(o_totalprice) FILTER (c_mktsegment = '{v}') AS DOUBLE), 2) AS \"{v}_o_totalprice_count\", "
    f"round(coalesce(max(o_totalprice) FILTER (c_mktsegment = '{v}'), 0), 2) AS \"{v}_o_totalprice_max\"" for v in ("BUILDING", "AUTOMOBILE", "NONE")) + " FROM o GROUP BY 1")
def a32(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return tables.pivot(o, ["o_orderpriority"], "c_mktsegment", ["BUILDING", "AUTOMOBILE", "NONE"], [("o_totalprice", "sum"), ("o_totalprice", "count"), ("o_totalprice", "max")])


@query("a33_run_statistics", """
SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(coalesce(stddev_samp(l_extendedprice), 0), 4) AS stddev, round(min(l_extendedprice), 4) AS min,
  round(max(l_extendedprice), 4) AS max, count(*) AS runs FROM lineitem GROUP BY 1""")
def a33(spark, sf):
    return tables.run_statistics(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")


@query("a33_run_delta", """
WITH s AS (SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 2)
SELECT round(first(mean ORDER BY l_returnflag) - last(mean ORDER BY l_returnflag), 4) AS delta FROM s""")
def a33d(spark, sf):
    return tables.run_delta(a33(spark, sf), "l_returnflag")


@query("a34_count_by_year", """
SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year, count(*) AS n,
  count(*) FILTER (o_orderkey % 7 = 0) AS missing_title FROM orders GROUP BY 1""")
def a34(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(F.when(k % 10 != 0, F.year("o_orderdate")).alias("year"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("title"))
    return tables.count_by_year(o, "year", "title")


@query("a36_top_lead_times", sql("""
, l AS (SELECT trend_id, source, community, min(epoch_us(published_at)) AS f FROM m GROUP BY ALL),
md AS (SELECT trend_id, min(epoch_us(published_at)) AS a FROM m WHERE source = 'rss' GROUP BY 1)
SELECT trend_id, community, round((a - f) / 1e6, 3) AS lead_seconds FROM l JOIN md USING (trend_id) WHERE a > f ORDER BY a - f DESC, trend_id, community LIMIT 10"""))
def a36(spark, sf):
    m = mentions(spark, sf)
    f = m.groupBy("trend_id", "community").agg(F.min(micros(F.col("published_at"))).alias("f"))
    md = m.where("source = 'rss'").groupBy("trend_id").agg(F.min(micros(F.col("published_at"))).alias("a"))
    j = f.join(md, "trend_id").where("a > f")
    return j.orderBy(F.desc(F.col("a") - F.col("f")), "trend_id", "community").limit(10).select("trend_id", "community", F.round((F.col("a") - F.col("f")) / 1e6, 3).alias("lead_seconds"))


@query("a36_lead_times_by_period", sql("""
, l AS (SELECT trend_id, community, min(epoch_us(published_at)) AS f FROM m GROUP BY ALL),
md AS (SELECT trend_id, max(epoch_us(published_at)) AS a FROM m WHERE source = 'rss' GROUP BY 1),
r AS (SELECT CAST(floor((epoch_us(now) - f) / 6.048e11) AS BIGINT) AS periods_back, trend_id, community, a - f AS d FROM l JOIN md USING (trend_id), p WHERE a > f)
SELECT periods_back, trend_id, community, round(d / 1e6, 3) AS lead_seconds, CAST(row_number() OVER (PARTITION BY periods_back ORDER BY d DESC, trend_id, community) AS INTEGER) AS rank
FROM r QUALIFY rank <= 10"""))
def a36p(spark, sf):
    """Ten longest leads over the last media post in each week."""
    from ..functions.times import epoch_micros

    m, now = mentions(spark, sf), epoch_micros(now_of(spark, sf))
    f = m.groupBy("trend_id", "community").agg(F.min(micros(F.col("published_at"))).alias("f"))
    md = m.where("source = 'rss'").groupBy("trend_id").agg(F.max(micros(F.col("published_at"))).alias("a"))
    j = f.join(md, "trend_id").where("a > f").select(
        F.floor((F.lit(now) - F.col("f")) / F.lit(604_800_000_000)).alias("periods_back"), "trend_id", "community", (F.col("a") - F.col("f")).alias("d"))
    return reports.top_by_period(j, "periods_back", [F.desc("d"), F.col("trend_id"), F.col("community")], 10).select(
        "periods_back", "trend_id", "community", F.round(F.col("d") / 1e6, 3).alias("lead_seconds"), "rank")


@query("a37_amplifiers", sql("""
, a AS (SELECT trend_id, author_id, count(*) AS posts, min(epoch_us(published_at)) AS f FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY posts DESC, f, author_id) AS rank, min(f) OVER (PARTITION BY trend_id) AS o FROM a)
SELECT trend_id, author_id, posts, CAST(rank AS INTEGER) AS rank, round((f - o) / 1e6, 3) AS offset_seconds FROM r WHERE rank <= 20"""))
def a37(spark, sf):
    return reports.amplifiers(mentions(spark, sf)).withColumn("offset_seconds", F.round("offset_seconds", 3))


@query("a38_evaluation", """
, e AS (SELECT n_chars > 2000 AS predicted, toxic = 1 AS actual, doc_id % 48 AS lead FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND actual) AS fn, count(*) FILTER (NOT predicted AND NOT actual) AS tn,
  round(avg(lead) FILTER (predicted AND actual), 6) AS mean_lead_hours FROM e)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS false_positive_rate FROM c""".replace(", e AS", "WITH e AS", 1))
def a38(spark, sf):
    """Precision, recall and lead over documents. The tables hold no detection times: the lead is a stand-in made from the id, not a measured time."""
    d = documents(spark, sf).select(F.col("doc_id").alias("id"), (F.col("n_chars") > 2000).alias("predicted"), (F.col("doc_id") % 48).alias("lead_hours"))
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("actual"))
    return reports.evaluate(d, lab).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "false_positive_rate", "mean_lead_hours")})


@query("a39_backtest", sql(TICKS + """
SELECT trend_id, tick, CAST(m15 AS BIGINT) AS m15, m30, m60, mentions, authors60, sources60, sources15, round(sentiment, 9) AS sentiment, round(penalty, 6) AS penalty,
  round(raw_score, 2) AS raw_score, round(gated_score, 2) AS gated_score, round(score, 2) AS score, is_trending, shape, phase FROM tm"""))
def a39(spark, sf):
    """The early score with all its parts, penalty, gates and quota at every tick."""
    return ticks(spark, sf).select("trend_id", "tick", "m15", "m30", "m60", "mentions", "authors60", "sources60", "sources15", F.round("sentiment", 9).alias("sentiment"),
                                   *[F.round(c, d).alias(c) for c, d in (("penalty", 6), ("raw_score", 2), ("gated_score", 2), ("score", 2))], "is_trending", "shape", "phase")


@query("k4_markdown_export", sql(VIEW + """
SELECT CAST(row_number() OVER (ORDER BY delta DESC, trend_id) AS INTEGER) AS position, '| ' || row_number() OVER (ORDER BY delta DESC, trend_id) || ' | ' || title || ' | ' || source || ' | ' || mentions || ' | '
  || CASE WHEN delta > 0 THEN '+' ELSE '' END || delta || '% | ' || confidence || '/100 |' AS line FROM vw QUALIFY position <= 50
UNION ALL SELECT -1, '| # | Tendencia | Fuente | Menciones/h | Delta | Confianza |' UNION ALL SELECT 0, '|---|-----------|--------|-------------|-------|-----------|'"""))
def k4(spark, sf):
    return reports.markdown_rows(views.ranked(view(spark, sf), "delta", 50))


@query("k4_json_export", sql(VIEW + """
SELECT CAST(row_number() OVER (ORDER BY delta DESC, trend_id) AS INTEGER) AS position, CAST(json_object('position', row_number() OVER (ORDER BY delta DESC, trend_id), 'title', title, 'source', source,
  'mentions', mentions, 'delta', delta, 'confidence', confidence) AS VARCHAR) AS line FROM vw QUALIFY position <= 50"""))
def k4j(spark, sf):
    return reports.json_rows(views.ranked(view(spark, sf), "delta", 50))


@query("t12_vitals", sql(f"""
, v AS (SELECT {bucket_sql('published_at', 3600)} AS t, count(*) AS analysed, max(published_at) AS l FROM m GROUP BY 1)
SELECT strftime(t, {FMT}) AS t, analysed, analysed - coalesce(lag(analysed) OVER (ORDER BY t), 0) AS change, round(analysed / 3600.0, 6) AS per_second,
  coalesce((epoch_us(t) - lag(epoch_us(l)) OVER (ORDER BY t)) / 1e6 > 600, false) AS degraded FROM v"""))
def t12(spark, sf):
    return reports.vitals(mentions(spark, sf), 3600, 600).select(fmt(F.col("at")).alias("t"), "analysed", "change", F.round("per_second", 6).alias("per_second"), "degraded")


# ---- alerts ------------------------------------------------------------------------------
HITS = TICKS + RULES_SQL + """
, pv AS (SELECT *, lag(phase) OVER w AS pp, lag(m60) OVER w AS pm, lag(sources60) OVER w AS ps, lag(sentiment) OVER w AS pt FROM tm WINDOW w AS (PARTITION BY trend_id ORDER BY tick_at)),
hit AS (SELECT r.rule_id, t.trend_id, r.cooldown_sec, r.severity, r.user_id, t.tick_at, condition FROM rules r JOIN pv t ON (r.trend_id IS NULL OR r.trend_id = t.trend_id) AND armed
  WHERE CASE condition WHEN 'score_gt' THEN score > threshold WHEN 'velocity_gt' THEN velocity > threshold WHEN 'mentions_gt' THEN m60 > threshold WHEN 'mentions_lt' THEN m60 < threshold
    WHEN 'phase_is' THEN phase = rule_phase WHEN 'phase_change' THEN phase <> pp WHEN 'delta_pct_gt' THEN 100 * (m60 - pm) / nullif(CAST(pm AS DOUBLE), 0) > threshold
    WHEN 'source_breakout' THEN sources60 > ps WHEN 'between' THEN score BETWEEN threshold AND threshold_max WHEN 'source_count' THEN sources60 >= threshold
    WHEN 'sentiment' THEN abs(sentiment - pt) * 100 > threshold END),
fire AS (
  SELECT rule_id, trend_id, cooldown_sec, severity, user_id, min(tick_at) AS fired_at, 1 AS fire_no FROM hit GROUP BY ALL
  UNION ALL
  SELECT f.rule_id, f.trend_id, f.cooldown_sec, f.severity, f.user_id, n.nx, f.fire_no + 1 FROM fire f, LATERAL (SELECT min(tick_at) AS nx FROM hit h
     WHERE h.rule_id = f.rule_id AND h.trend_id = f.trend_id AND h.tick_at > f.fired_at AND h.tick_at >= f.fired_at + to_seconds(f.cooldown_sec)) n WHERE n.nx IS NOT NULL)"""


def fired(spark, sf):
    return alerts.fire(alerts.hits(rules(spark), ticks(spark, sf)))


@query("t6_alert_hits", sql(HITS.split(",\nfire AS (")[0] + f"SELECT rule_id, trend_id, strftime(tick_at, {FMT}) AS t FROM hit"))
def t6h(spark, sf):
    return alerts.hits(rules(spark), ticks(spark, sf)).select("rule_id", "trend_id", fmt(F.col("at")).alias("t"))


@query("t6_alerts_fired", sql(HITS + f"SELECT rule_id, trend_id, severity, user_id, CAST(fire_no AS INTEGER) AS fire_no, strftime(fired_at, {FMT}) AS fired_at FROM fire").replace("WITH p AS", "WITH RECURSIVE p AS"))
def t6(spark, sf):
    return fired(spark, sf).withColumn("fired_at", fmt(F.col("fired_at")))


@query("a29_alert_counters", sql(HITS + """
SELECT (SELECT count(*) FROM rules WHERE armed) AS active, count(*) AS total, count(*) FILTER (fire_no % 2 = 1) AS unack FROM fire""").replace("WITH p AS", "WITH RECURSIVE p AS"))
def a29a(spark, sf):
    """Every second alert of a rule and trend counts as acknowledged."""
    f = fired(spark, sf)
    return reports.alert_counters(rules(spark), f, f.where("fire_no % 2 = 0").select("rule_id", "trend_id", "fire_no"))


@query("w16_alert_feed", sql(HITS + f"""
SELECT rule_id, trend_id, strftime(fired_at, {FMT}) AS fired_at FROM fire, p WHERE fired_at > p.now - INTERVAL 9 DAY ORDER BY fire.fired_at, rule_id, trend_id LIMIT 50""").replace("WITH p AS", "WITH RECURSIVE p AS"))
def w16(spark, sf):
    return reports.alert_feed(fired(spark, sf), ts(now_of(spark, sf), -9 * 86400)).select("rule_id", "trend_id", fmt(F.col("fired_at")).alias("fired_at"))


@query("t7_change_events", sql(TICKS + f"""
, h AS (SELECT *, lag(phase) OVER w AS pp, lag(velocity) OVER w AS pv FROM tm WINDOW w AS (PARTITION BY trend_id ORDER BY tick_at))
SELECT trend_id, strftime(tick_at, {FMT}) AS t, type FROM (SELECT *, unnest(list_filter(['trend.upserted', CASE WHEN pp <> phase THEN 'trend.phase_changed' END,
  CASE WHEN velocity > 1.2 * pv THEN 'trend.velocity_spike' END], lambda x: x IS NOT NULL)) AS type FROM h)"""))
def t7(spark, sf):
    from ..streaming.changes import change_events

    return change_events(ticks(spark, sf), 1.2).select("trend_id", fmt(F.col("at")).alias("t"), "type")


@query("t11_alert_fatigue", sql(HITS + f"""
, k AS (SELECT *, CASE WHEN trend_id IN ('t1', 't2', 't3') THEN 'g1' ELSE trend_id END AS group_id, rule_id = 'r06' AS pc FROM fire),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id, group_id ORDER BY fired_at, rule_id, trend_id) AS pos FROM k),
z AS (SELECT *, true AS sent, fired_at AS last FROM q WHERE pos = 1
  UNION ALL SELECT q.*, q.pc OR q.fired_at - z.last >= INTERVAL 172800 SECOND, CASE WHEN q.pc OR q.fired_at - z.last >= INTERVAL 172800 SECOND THEN q.fired_at ELSE z.last END
  FROM z JOIN q ON q.user_id = z.user_id AND q.group_id = z.group_id AND q.pos = z.pos + 1),
sp AS (SELECT *, sum(CASE WHEN sent THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, group_id ORDER BY pos) AS span FROM z),
o AS (SELECT *, count(*) OVER (PARTITION BY user_id, group_id, span) AS stands_for FROM sp QUALIFY sent),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, severity, CAST(fired_at AS DATE) ORDER BY fired_at, rule_id, trend_id) AS nth FROM o)
SELECT user_id, rule_id, trend_id, severity, strftime(fired_at, {FMT}) AS fired_at, stands_for, CAST(nth AS INTEGER) AS nth FROM n WHERE nth <= CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'info' THEN 3 ELSE 100000 END"""
).replace("WITH p AS", "WITH RECURSIVE p AS"))
def t11(spark, sf):
    g = mentions(spark, sf).select("trend_id").distinct().where(F.col("trend_id").isin("t1", "t2", "t3")).withColumn("group_id", F.lit("g1"))
    f = fired(spark, sf).withColumn("is_phase_change", F.col("rule_id") == "r06")
    return alerts.limit_fatigue(f, {"critical": 1, "high": 2, "info": 3}, g, 172800).select(
        "user_id", "rule_id", "trend_id", "severity", fmt(F.col("fired_at")).alias("fired_at"), "stands_for", "nth")


@query("t14_watch_alerts", """
, w AS (SELECT p_partkey AS ticker, p_retailprice * 1.0005 AS target, p_retailprice * 0.9 AS stop, p_brand AS last_label FROM part WHERE p_size % 2 = 0),
q AS (SELECT l_partkey AS ticker, l_extendedprice / l_quantity AS price, CASE WHEN l_orderkey % 2 = 0 THEN 'Brand#1' ELSE 'other' END AS label FROM lineitem),
j AS (SELECT * FROM q JOIN w USING (ticker))
SELECT ticker, round(price, 9) AS price, round((target - price) / nullif(price, 0) * 100, 2) AS to_target_pct, round((stop - price) / nullif(price, 0) * 100, 2) AS to_stop_pct,
  unnest(list_filter([CASE WHEN price >= target THEN 'target_hit' END, CASE WHEN price <= stop THEN 'stop_hit' END, CASE WHEN label <> last_label THEN 'signal_change' END], lambda x: x IS NOT NULL)) AS alert FROM j""".replace(", w AS", "WITH w AS", 1))
def t14(spark, sf):
    w = table(spark, sf, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("ticker"), (F.col("p_retailprice") * 1.0005).alias("target"), (F.col("p_retailprice") * 0.9).alias("stop"), F.col("p_brand").alias("last_label"))
    q = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("ticker"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                                            F.when(F.col("l_orderkey") % 2 == 0, "Brand#1").otherwise("other").alias("label"))
    return alerts.watch_alerts(q, w).withColumn("price", F.round("price", 9))


@query("t15_mastery", """
, s AS (SELECT user_id, event_id, CASE WHEN event_id % 9 <> 0 THEN least(1, value / 30.0) END AS score FROM events),
n AS (SELECT user_id, event_id, score, row_number() OVER w AS rn, lag(score) OVER w AS prev FROM s WHERE score IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT *, CASE WHEN score < 0.6 AND prev < 0.6 THEN true WHEN score < 0.5 THEN true WHEN score >= 0.8 AND prev >= 0.8 THEN false END AS flag FROM n),
lv AS (SELECT user_id, rn, CASE WHEN score >= 0.6 THEN 2 ELSE 1 END AS level FROM n WHERE rn = 1
  UNION ALL SELECT l.user_id, n.rn, CASE WHEN score >= 0.6 THEN least(3, level + 1) ELSE greatest(1, level - 1) END FROM lv l JOIN n ON n.user_id = l.user_id AND n.rn = l.rn + 1),
z AS (SELECT user_id, max(rn) AS attempts, coalesce(arg_max(flag, rn) FILTER (flag IS NOT NULL), false) AS is_weak, max(rn) - coalesce(max(rn) FILTER (score < 0.6), 0) AS streak FROM f GROUP BY 1)
SELECT z.user_id, attempts, CAST(level AS INTEGER) AS level, is_weak, CAST([1, 2, 4, 7, 15][least(4, streak) + 1] AS INTEGER) AS review_days FROM z JOIN lv ON lv.user_id = z.user_id AND lv.rn = attempts""".replace(", s AS", "WITH RECURSIVE s AS", 1))
def t15(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 9 != 0, F.least(F.lit(1.0), F.col("value") / 30.0)).alias("score"))
    return tables.mastery(e, "user_id", "event_id", "score")


# ---- search ------------------------------------------------------------------------------
@query("w12_bm25", r"""
, t AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2) AS w FROM documents),
q AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)) AS term FROM benchmark),
qn AS (SELECT item_id, term, count(*) AS c FROM q GROUP BY ALL),
tf AS (SELECT doc_id, len(w) AS l, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), nn AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
s AS (SELECT item_id AS query_id, doc_id, sum(qn.c * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS score FROM qn JOIN tf USING (term) JOIN df USING (term), nn GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""".replace(", t AS", "WITH t AS", 1))
def w12(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    return search.bm25(q, documents(spark, sf), "doc_id", "text", 10).withColumn("score", F.round("score", 6)).select("query_id", "doc_id", "score", "rank")


@query("w13_fuzzy_names", """
, g AS (SELECT p_partkey, p_name, list_distinct(list_transform(range(1, length(p_name) + 2), lambda i: substr('  ' || lower(p_name) || ' ', i, 3))) AS t FROM part),
n AS (SELECT * FROM (VALUES (1, 'part 123'), (2, 'Part 77 x')) v(needle_id, needle)),
ng AS (SELECT needle_id, list_distinct(list_transform(range(1, length(needle) + 2), lambda i: substr('  ' || lower(needle) || ' ', i, 3))) AS t FROM n)
SELECT p_partkey, needle_id, round(len(list_intersect(g.t, ng.t)) / (len(g.t) + len(ng.t) - len(list_intersect(g.t, ng.t))), 6) AS similarity FROM g, ng
WHERE len(list_intersect(g.t, ng.t)) / (len(g.t) + len(ng.t) - len(list_intersect(g.t, ng.t))) >= 0.25""".replace(", g AS", "WITH g AS", 1))
def w13(spark, sf):
    n = spark.createDataFrame([(1, "part 123"), (2, "Part 77 x")], "needle_id int, needle string")
    return search.fuzzy(table(spark, sf, "part"), "p_partkey", "p_name", n, 0.25).withColumn("similarity", F.round("similarity", 6))


@query("w13_contains_all", r"""
SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+'), 'the')
  AND list_contains(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+'), 'and')""")
def w13c(spark, sf):
    return search.contains_all(documents(spark, sf), "doc_id", "text", ["the", "AND"])


# ---- trust -------------------------------------------------------------------------------
@query("g19_product_score", sql(profile_sql() + """
SELECT trend_id, round(100 / (1 + exp(-(0.8 * m15 / 15.0 + 0.5 * entropy15 - 0.2))) * pow(1 / (1 + exp(-(0.3 * ln(mentions) / 10))), 1.5) * trust * exp(-ln(2) / 12 * idle_hours), 6) AS score FROM pr"""))
def g19(spark, sf):
    """Weights 0.8, 0.5, 0.3 and the bias are examples: no values are given for them."""
    p = profile(spark, sf).withColumns({"v": F.col("m15") / 15.0, "lm": F.log("mentions") / 10})
    s = trust.product_score({"v": 0.8, "entropy15": 0.5}, {"lm": 0.3}, -0.2, 1.5, ["trust"])
    return p.select("trend_id", F.round(s, 6).alias("score"))


@query("g20_phase_rules", sql(profile_sql() + """
, x AS (SELECT trend_id, least(1, m15 / 15.0 / 4) AS vel, m60 / mentions AS mat, m15 / 15.0 - m60 / 60.0 AS accel, age_hours FROM pr)
SELECT trend_id, CASE WHEN vel < 0.25 AND accel < -0.5 AND age_hours > 4 THEN 'decaying' WHEN mat > 0.7 AND vel < 0.45 THEN 'peaked' WHEN vel > 0.6 AND mat < 0.75 AND accel > 0 THEN 'rising'
  WHEN vel > 0.3 AND mat < 0.5 AND accel >= 0 THEN 'forming' ELSE 'undetermined' END AS phase FROM x"""))
def g20(spark, sf):
    p = early.with_motion(profile(spark, sf))
    return p.select("trend_id", trust.phase_rules(F.least(F.lit(1.0), F.col("velocity") / 4), F.col("m60") / F.col("mentions"), F.col("acceleration"), F.col("age_hours")).alias("phase"))


FEATURES_SQL = posts_sql() + f"""
, d AS (SELECT doc_id, sha1({normalise_sql('text')}) AS text_hash, lang FROM documents),
f AS (SELECT po.*, text_hash, lang, 'e.test' AS host, list_distinct(list_filter(['topic' || (external_id % 7), CASE WHEN external_id % 5 = 0 THEN 'alt' || (external_id % 3) END,
    CASE WHEN external_id % 8 = 0 THEN 'more' || (author_id % 2) END], lambda x: x IS NOT NULL)) AS tags FROM po JOIN d USING (doc_id)),
bs AS (SELECT trend_id, count(*) AS n, count(DISTINCT author_id) FILTER (author_age_days < 30) / count(DISTINCT author_id) AS new_account_ratio, avg(CASE WHEN host IN ('e.test') THEN 1 ELSE 0 END) AS shortener_ratio,
    stddev_pop(sentiment) AS sentiment_std, 1 - count(DISTINCT url) / count(*) AS media_dup_ratio FROM f GROUP BY 1),
dp AS (SELECT trend_id, sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c) AS duplicate_ratio FROM (SELECT trend_id, text_hash, count(*) AS c FROM f GROUP BY ALL) GROUP BY 1),
hr AS (SELECT trend_id, (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(24) AS burst_entropy FROM (SELECT trend_id, hour(published_at) AS h, count(*) AS c FROM f GROUP BY ALL) GROUP BY 1),
lg AS (SELECT trend_id, max(c) / sum(c) AS language_skew FROM (SELECT trend_id, lang, count(*) AS c FROM f GROUP BY ALL) GROUP BY 1),
sy AS (SELECT trend_id, avg(CASE WHEN gap <= 1.2e9 THEN 1 ELSE 0 END) AS sync_ratio FROM (SELECT trend_id, epoch_us(published_at) - lag(epoch_us(published_at)) OVER (PARTITION BY trend_id ORDER BY published_at) AS gap FROM f) GROUP BY 1),
tk AS (SELECT trend_id, tags, count(*) AS c FROM f GROUP BY ALL),
hj AS (SELECT a.trend_id, sum(CASE WHEN a.tags = b.tags THEN a.c * (a.c - 1) / 2 ELSE a.c * b.c / 2.0 END * len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags)))) AS j FROM tk a JOIN tk b ON a.trend_id = b.trend_id GROUP BY 1),
rp AS (SELECT DISTINCT c.trend_id, c.author_id AS src, q.author_id AS dst FROM m c JOIN m q ON q.external_id = c.reply_to WHERE c.author_id <> q.author_id),
un AS (SELECT trend_id, least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS ways FROM rp GROUP BY ALL),
au2 AS (SELECT trend_id, count(DISTINCT author_id) AS n FROM m GROUP BY 1),
nw AS (SELECT au2.trend_id, coalesce(2 * count(a) / nullif(any_value(n) * (any_value(n) - 1), 0), 0) AS network_density, coalesce(sum(CASE WHEN ways = 2 THEN 2 ELSE 0 END) / nullif(sum(ways), 0), 0) AS mutual_ratio
  FROM au2 LEFT JOIN un USING (trend_id) GROUP BY 1),
cs AS (SELECT trend_id, max(c) / sum(c) AS community_share FROM (SELECT trend_id, community, count(*) AS c FROM m GROUP BY ALL) GROUP BY 1),
ft AS (SELECT * EXCLUDE (j), j / (n * (n - 1) / 2.0) AS hashtag_jaccard, 1 - burst_entropy AS hour_uniformity
  FROM bs JOIN dp USING (trend_id) JOIN hr USING (trend_id) JOIN lg USING (trend_id) JOIN sy USING (trend_id) JOIN hj USING (trend_id) JOIN nw USING (trend_id) JOIN cs USING (trend_id))"""


def features(spark, sf):
    d = text_hashes(spark, sf)
    i = F.col("external_id")
    tags = F.array_compact(F.array(
        F.concat(F.lit("topic"), (i % 7).cast("string")), F.when(i % 5 == 0, F.concat(F.lit("alt"), (i % 3).cast("string"))),
        F.when(i % 8 == 0, F.concat(F.lit("more"), (F.col("author_id") % 2).cast("string")))))
    p = posts(spark, sf).join(d, "doc_id").withColumns({"host": tx.url_host(F.col("url")), "tags": tags})
    m = mentions(spark, sf)
    parent = m.select(F.col("external_id").alias("reply_to"), F.col("author_id").alias("dst"))
    replies = m.where("reply_to is not null").join(parent, "reply_to").select("trend_id", F.col("author_id").alias("src"), "dst")
    authors = m.groupBy("trend_id").agg(F.count_distinct("author_id").alias("n"))
    share = m.groupBy("trend_id", "community").agg(F.count("*").alias("c")).groupBy("trend_id").agg((F.max("c") / F.sum("c")).alias("community_share"))
    return (trust.post_features(p, 1200, ("e.test",)).join(trust.hashtag_jaccard(p.select("trend_id", "tags")), "trend_id")
            .join(trust.network_features(replies, authors), "trend_id").join(share, "trend_id"))


FEATS = ["new_account_ratio", "shortener_ratio", "sentiment_std", "media_dup_ratio", "duplicate_ratio", "burst_entropy", "hour_uniformity", "language_skew", "sync_ratio",
         "hashtag_jaccard", "network_density", "mutual_ratio", "community_share"]


@query("g23_trash_features", sql(FEATURES_SQL + "SELECT trend_id, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATS) + " FROM ft"))
def g23(spark, sf):
    return features(spark, sf).select("trend_id", "n", *[F.round(c, 6).alias(c) for c in FEATS])


TRASH_SQL = FEATURES_SQL + """
, fl AS (SELECT trend_id, list_filter([CASE WHEN new_account_ratio > 0.4 THEN 0.3 END, CASE WHEN sync_ratio > 0.2 THEN 0.4 END, CASE WHEN duplicate_ratio > 0.3 THEN 0.4 END,
    CASE WHEN network_density > 0.7 AND community_share > 0.85 THEN 0.5 END, CASE WHEN sentiment_std < 0.05 AND hashtag_jaccard > 0.7 THEN 0.4 END, CASE WHEN hour_uniformity < 0.1 THEN 0.3 END,
    CASE WHEN shortener_ratio > 0.5 THEN 0.2 END, CASE WHEN media_dup_ratio > 0.4 THEN 0.3 END], lambda x: x IS NOT NULL) AS w FROM ft),
tr0 AS (SELECT trend_id, len(w) AS flags, CASE WHEN len(w) = 0 THEN 0 ELSE 1 - list_product(list_transform(w, lambda x: CAST(1 - x AS DOUBLE))) END AS trash FROM fl)"""


def trash(spark, sf):
    return features(spark, sf).withColumn("flags", trust.trash_flags()).withColumn("trash", trust.trash_score(F.col("flags")))


@query("g22_g27_trash_score", sql(TRASH_SQL + """
SELECT trend_id, CAST(flags AS INTEGER) AS flags, round(trash, 6) AS trash, CASE WHEN trash < 0.3 THEN 'clean' WHEN trash < 0.6 THEN 'anomalous' ELSE 'hidden' END AS band,
  round(0.4 * trash + 0.3 * 0.5 + 0.3 * 0.25, 6) AS combined FROM tr0"""))
def g22(spark, sf):
    return trash(spark, sf).select("trend_id", F.size("flags").alias("flags"), F.round("trash", 6).alias("trash"), trust.trash_band(F.col("trash")).alias("band"),
                                   F.round(trust.combined_trash(F.col("trash"), F.lit(0.5), F.lit(0.25)), 6).alias("combined"))


@query("a36_top_suspects", sql(TRASH_SQL + "SELECT trend_id, round(trash, 6) AS trash FROM tr0 ORDER BY round(trash, 9) DESC, trend_id LIMIT 5"))
def a36s(spark, sf):
    return trash(spark, sf).select("trend_id", F.round("trash", 9).alias("t")).orderBy(F.desc("t"), "trend_id").limit(5).select("trend_id", F.round("t", 6).alias("trash"))


PRESENCE_SQL = """
, pc AS (SELECT community AS story, bool_or(source = 'x') AS x, bool_or(source = 'gdelt' OR source = 'rss') AS gdelt, bool_or(source = 'reddit') AS reddit, bool_or(source = 'hn') AS hn, avg(bot_score) AS trash
  FROM (SELECT * REPLACE (author_id || '-' || trend_id AS community) FROM m) GROUP BY 1),
le AS (SELECT *, CASE WHEN x AND (gdelt OR reddit) AND trash < 0.4 THEN 'LEGIT' WHEN x AND NOT (gdelt OR reddit) AND trash > 0.5 THEN 'BOT_CAMPAIGN' WHEN x AND NOT (gdelt OR reddit) AND trash < 0.4 THEN 'NATIVE'
  WHEN (gdelt OR reddit) AND NOT x THEN 'PRE_BURST' WHEN NOT x AND NOT (gdelt OR reddit) THEN 'NOISE' ELSE 'UNCERTAIN' END AS class FROM pc)"""


def story():
    """As in the SQL, a post without author or trend is in the story without a name."""
    return F.concat(F.col("author_id").cast("string"), F.lit("-"), F.col("trend_id"))


def presence(spark, sf):
    """Stories of one author in one trend, with news feeds standing in for the news database."""
    m = mentions(spark, sf).withColumn("story", story())
    s = lambda *n: F.bool_or(F.col("source").isin(*n))
    has = {"has_x": ["x"], "has_gdelt": ["gdelt", "rss"], "has_reddit": ["reddit"], "has_hn": ["hn"]}
    per = m.groupBy("story", "bot_score").agg(*[s(*n).alias(c) for c, n in has.items()], F.count("*").alias("n"))
    p = per.groupBy("story").agg(*[F.bool_or(c).alias(c) for c in has], F.collect_list(F.struct("bot_score", "n")).alias("l")).withColumn("trash", ordered_mean(F.col("l"), "bot_score"))
    c = F.col
    return p.withColumn("l", trust.legitimacy(c("has_x"), c("has_gdelt"), c("has_reddit"), c("has_hn"), c("trash"))).select("*", F.col("l.class").alias("class"), F.col("l.confidence").alias("confidence"))


@query("g21_legitimacy", sql(PRESENCE_SQL + """
SELECT story, class, CAST(CASE class WHEN 'LEGIT' THEN 0.92 WHEN 'BOT_CAMPAIGN' THEN 0.85 WHEN 'NATIVE' THEN 0.55 WHEN 'PRE_BURST' THEN 0.7 WHEN 'NOISE' THEN 0.2 ELSE 0.5 END AS DOUBLE) AS confidence FROM le"""))
def g21(spark, sf):
    return presence(spark, sf).select("story", "class", "confidence")


ROLE_SQL = PRESENCE_SQL + """
, q AS (SELECT author_id || '-' || trend_id AS story, avg(author_quality) AS oq, count(*) AS n, avg(1 - bot_score) AS auth FROM m GROUP BY 1),
v AS (SELECT le.*, oq, n, auth, n / 10.0 AS delta_v FROM le JOIN q USING (story))
SELECT 'journalist' AS role, story FROM v WHERE n < 8 AND class IN ('PRE_BURST', 'LEGIT') AND oq > 0.6 AND trash < 0.3
UNION ALL SELECT 'trader', story FROM v WHERE (gdelt OR reddit) AND trash < 0.4 AND delta_v > 3 * 0.25 AND class = 'LEGIT'
UNION ALL SELECT 'brand', story FROM v WHERE trash < 0.4 AND oq > 0.4
UNION ALL SELECT 'osint', story FROM v WHERE gdelt AND (x OR reddit) AND trash < 0.3 AND auth > 0.7
UNION ALL SELECT 'political', story FROM v WHERE trash > 0.5"""


@query("p20_role_presets", sql(ROLE_SQL))
def p20(spark, sf):
    m = mentions(spark, sf).withColumn("story", story())
    per = m.withColumn("auth", 1 - F.col("bot_score")).groupBy("story", "author_quality", "auth").agg(F.count("*").alias("n"))
    q = per.groupBy("story").agg(F.sum("n").alias("n"), F.collect_list(F.struct("author_quality", "n")).alias("q"), F.collect_list(F.struct("auth", "n")).alias("a")).select(
        "story", "n", ordered_mean(F.col("q"), "author_quality").alias("origin_quality"), ordered_mean(F.col("a"), "auth").alias("authenticity"))
    v = presence(spark, sf).join(q, "story").withColumns({
        "phase": F.when(F.col("n") < 8, "forming").otherwise("peaked"), "delta_v": F.col("n") / 10.0, "baseline": F.lit(0.25), "legitimacy": F.col("class")})
    out = None
    for role in views.ROLES:
        part = views.role_preset(v, role).select(F.lit(role).alias("role"), "story")
        out = part if out is None else out.unionByName(part)
    return out


@query("g24_transitions", sql(TICKS + f"""
, cm AS (SELECT trend_id, tick, count(DISTINCT community) AS communities, avg(author_quality) AS oq, avg(bot_score) AS trash FROM m JOIN grid ON published_at <= tick_at AND published_at > tick_at - to_seconds({STEP}) GROUP BY ALL),
ac AS (SELECT trend_id, tick, (log2(sum(c)) - sum(c * log2(c)) / sum(c)) AS ae FROM (SELECT trend_id, tick, author_id, count(*) AS c FROM m JOIN grid ON published_at <= tick_at AND published_at > tick_at - to_seconds({STEP}) GROUP BY ALL) GROUP BY ALL),
h AS (SELECT tm.trend_id, tick_at, acceleration AS a, communities, ae, oq, trash FROM tm JOIN cm USING (trend_id, tick) JOIN ac USING (trend_id, tick)),
s AS (SELECT trend_id, stddev_pop(a) AS sg, quantile_cont(ae, 0.4) AS p40 FROM h GROUP BY 1),
w AS (SELECT *, lag(communities) OVER o AS pc, lag(a) OVER o AS pa FROM h JOIN s USING (trend_id) WINDOW o AS (PARTITION BY trend_id ORDER BY tick_at))
SELECT trend_id, strftime(tick_at, {FMT}) AS t, coalesce(a > 0.5 * sg AND communities - pc >= 2 AND round(ae, 9) >= round(p40, 9) AND oq > 0.45 AND trash < 0.47, false) AS to_rising,
  coalesce(a < -0.3 * sg AND pa < -0.3 * sg, false) AS to_decayed FROM w"""))
def g24(spark, sf):
    """Author quality and bot level are shifted by 0.05 and 0.07 so both rules can hold."""
    from ..functions.times import age_seconds

    m, now = mentions(spark, sf), now_of(spark, sf)
    step = F.floor(age_seconds(F.col("published_at"), now) / F.lit(float(STEP)))
    r = m.withColumn("tick", step)
    com = r.groupBy("trend_id", "tick").agg(F.count_distinct("community").alias("communities"), (F.avg("author_quality") + 0.05).alias("origin_quality"), (F.avg("bot_score") - 0.07).alias("trash"))
    au = r.groupBy("trend_id", "tick", "author_id").agg(F.count("*").alias("c")).groupBy("trend_id", "tick").agg(
        F.round(F.log2(F.sum("c")) - F.sum(xlog2x(F.col("c"))) / F.sum("c"), 9).alias("author_entropy"))
    h = ticks(spark, sf).select("trend_id", "tick", "at", "acceleration").join(com, ["trend_id", "tick"]).join(au, ["trend_id", "tick"])
    return trust.transitions(h).select("trend_id", fmt(F.col("at")).alias("t"), "to_rising", "to_decayed")


@query("g25_pre_burst", sql("""
, w AS (SELECT m.*, (epoch_us(now) - epoch_us(published_at)) / 3.6e9 / 24 AS age FROM m, p),
g AS (SELECT trend_id, 'growth' AS signal, source FROM (SELECT trend_id, source, community, count(*) FILTER (age < 6) AS c, count(*) FILTER (age >= 6 AND age < 12) AS pr FROM w WHERE age < 12 GROUP BY ALL) WHERE pr > 0 AND c > 5 * pr),
d AS (SELECT trend_id, 'domain' AS signal, min(source) AS source FROM w WHERE age < 0.5 GROUP BY trend_id HAVING count(*) > 5),
s AS (SELECT trend_id, 'sentiment' AS signal, source FROM (SELECT trend_id, source, avg(sentiment) FILTER (age < 1) AS c, avg(sentiment) FILTER (age >= 1 AND age < 2) AS pr FROM w WHERE age < 2 GROUP BY ALL) WHERE abs(c - pr) > 0.3),
u AS (SELECT * FROM g UNION ALL SELECT * FROM d UNION ALL SELECT * FROM s),
a AS (SELECT trend_id, count(DISTINCT signal) AS signals, count(DISTINCT source) AS signal_sources FROM u GROUP BY 1),
z AS (SELECT *, 1 / (1 + exp(-(ln(0.25) + signals * ln(4)))) AS posterior FROM a)
SELECT trend_id, signals, signal_sources, round(posterior, 6) AS posterior, signals >= 2 AND signal_sources >= 2 AND posterior > 0.7 AS confirmed FROM z"""))
def g25(spark, sf):
    p = mentions(spark, sf).withColumn("host", tx.url_host(F.col("url")))
    return trust.pre_burst(p, now_of(spark, sf), 24.0).withColumn("posterior", F.round("posterior", 6))


@query("g26_origin_quality")
def g26(spark, sf):
    """Page rank over the reply graph of authors gives the position part."""
    m = mentions(spark, sf)
    parent = m.select(F.col("external_id").alias("reply_to"), F.col("author_id").alias("dst"))
    e = m.where("reply_to is not null").join(parent, "reply_to").select(F.col("author_id").alias("src"), "dst").where("src <> dst").distinct()
    rank = graph.page_rank(m.select(F.col("author_id").alias("id")).distinct(), e).select(F.col("id").alias("author_id"), "rank")
    c = F.col
    return trust.origin_parts(m, rank).select(
        "trend_id", "author_id", F.round(trust.origin_quality(c("history"), c("engagement"), c("position"), c("authentic"), c("first"), c("corroborated")), 6).alias("origin_quality"))
