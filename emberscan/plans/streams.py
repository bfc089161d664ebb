"""Streaming queries over the given tables, each with its batch meaning as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.times import epoch_micros, fmt, ts
from ..operators import alerts
from ..session import cut, shared_dir
from ..streaming import clustering, events as ev, ingest, stateful, timers
from . import intake
from .analysis import HITS
from .derived import TICKS, rules, ticks
from .registry import query
from .views import SCALE, as_mentions, mentions, now_of, sql, table
from .windowed import bucket_sql

FMT = "'%Y-%m-%d %H:%M:%S'"


def stream(spark, sf):
    """Mentions as a stream over the landed event file."""
    e = ingest.landed_parquet(spark, sf, table(spark, sf, "events").schema, "events.parquet")
    docs = F.lit(table(spark, sf, "documents").count())
    return as_mentions(e, docs).withColumn("published_at", F.col("published_at").cast("timestamp"))


def in_landings(df, parts, order, run):
    """Rows landed in ``parts`` steps in the order of ``order``; after each, ``run(stream)`` works off what is new.

    The input is computed once; a landing has as many files as tasks wrote it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/l-{uuid.uuid4().hex}"
    rows = cut(df)
    lo, hi = rows.agg(F.min(order), F.max(order)).first()
    step = (hi - lo + 1) / parts
    for i in range(parts):
        rows.where(F.floor((F.col(order) - lo) / F.lit(float(step))) == i).write.mode("append").parquet(path)
        out = run(ingest.landed_parquet(spark, path, rows.schema))
    return out


def to_table(spark, transform):
    """``run`` of a transform that appends to one table and keeps its state between landings."""
    base = f"{shared_dir(spark)}/s-{uuid.uuid4().hex}"
    return lambda s: ingest.run_to_table(transform(s), path=base)


@query("t1_continuous_ingest", sql("SELECT external_id, source, trend_id, doc_id, community, url, reach FROM m"))
def t1(spark, sf):
    return ingest.run_to_table(stream(spark, sf).select("external_id", "source", "trend_id", "doc_id", "community", "url", "reach"))


@query("t1_stream_payloads", sql("""
SELECT 'reddit' AS source, 't3_' || external_id AS external_id, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM m, p
WHERE external_id % 13 <> 0 AND external_id % 17 <> 0 AND external_id % 19 <> 0 AND published_at >= now - INTERVAL 7 DAY"""))
def t1p(spark, sf):
    """Payload files in three landings, each with pages of the one before: parsed, gated, and repeats within the TTL dropped."""
    from ..sources import payloads as pay

    pages = cut(intake.reddit_pages(spark, sf))
    path = f"{shared_dir(spark)}/p-{uuid.uuid4().hex}"
    for i in range(3):
        again = (F.col("page") % 3 == (i + 2) % 3) & (F.col("page") % 2 == 0)
        pages.where((F.col("page") % 3 == i) | again).select("payload").write.mode("append").text(path)
    files = len(pages.sparkSession.read.text(path).inputFiles())
    s = pay.reddit_listing(ingest.landed_payloads(spark, path, -(-files // 3), per_line=True))
    s = s.withColumn("published_at", F.col("published_at").cast("timestamp"))
    kept = ingest.gate(s, now_of(spark, sf)).where("verdict = 'accepted'")
    out = ingest.run_to_table(ingest.dedup(kept, ["source", "external_id"]).select("source", "external_id", "published_at"))
    return out.select("source", "external_id", fmt(F.col("published_at")).alias("published_at"))


@query("t2_stream_gate", sql("""
SELECT CASE WHEN external_id % 7 = 0 THEN 'future' WHEN published_at < now - INTERVAL 7 DAY THEN 'too_old' ELSE 'accepted' END AS verdict, count(*) AS n FROM m, p GROUP BY 1"""))
def t2(spark, sf):
    now = now_of(spark, sf)
    s = stream(spark, sf)
    s = s.withColumn("published_at", F.when(F.col("external_id") % 7 == 0, F.lit(f"{now:%Y-%m-%d %H:%M:%S}").cast("timestamp") + F.expr("INTERVAL 6 MINUTES")).otherwise(F.col("published_at")))
    base = f"{shared_dir(spark)}/g-{uuid.uuid4().hex}"
    g = ingest.gate(s, now).select("external_id", "verdict")
    q = g.writeStream.foreachBatch(ingest.split_batches(f"{base}/ok", f"{base}/rejected")).option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    read = lambda name, schema: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/{name}")
    ok = read("ok", "external_id bigint").withColumn("verdict", F.lit("accepted"))
    return ok.unionByName(read("rejected", "external_id bigint, verdict string")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("t3_stream_dedup", sql("SELECT DISTINCT source, url FROM m"))
def t3(spark, sf):
    return ingest.run_to_table(ingest.dedup(stream(spark, sf), ["source", "url"]).select("source", "url"))


@query("t4_stream_tumbling", sql(f"""
SELECT strftime({bucket_sql('published_at', 21600)}, {FMT}) AS bucket, trend_id, source, count(*) AS mention_count, round(avg(sentiment), 6) AS avg_sentiment, CAST(sum(reach) AS BIGINT) AS total_reach
FROM m GROUP BY ALL"""))
def t4(spark, sf):
    out = ingest.run_to_table(ingest.tumbling(stream(spark, sf), "6 hours"), "update")
    last = ingest.last_per_key(out, ["bucket", "trend_id", "source"])
    return last.select(fmt(F.col("bucket")).alias("bucket"), "trend_id", "source", "mention_count", F.round("avg_sentiment", 6).alias("avg_sentiment"), "total_reach")


@query("t5_stream_sliding", sql("""
, w AS (SELECT trend_id, unnest(generate_series(CAST(floor(epoch_us(published_at) / 8.64e10) AS BIGINT) - 3, CAST(floor(epoch_us(published_at) / 8.64e10) AS BIGINT))) AS d FROM m)
SELECT strftime(make_timestamp(d * 86400000000), '%Y-%m-%d %H:%M:%S') AS start, trend_id, count(*) AS mentions FROM w GROUP BY ALL"""))
def t5(spark, sf):
    out = ingest.run_to_table(ingest.sliding_velocity(stream(spark, sf), "4 days", "1 day"), "update")
    return ingest.last_per_key(out, ["start", "end", "trend_id"]).select(fmt(F.col("start")).alias("start"), "trend_id", "mentions")


@query("t6_stream_alerts", sql(HITS + "SELECT rule_id, trend_id, CAST(fire_no AS INTEGER) AS fire_no, epoch_us(fired_at) AS at_us FROM fire").replace("WITH p AS", "WITH RECURSIVE p AS"))
def t6(spark, sf):
    us = F.unix_micros(F.col("at").cast("timestamp")).alias("at_us")
    h = alerts.hits(rules(spark), ticks(spark, sf)).select("rule_id", "trend_id", "cooldown_sec", us)
    return in_landings(h, 3, "at_us", to_table(spark, stateful.fire_alerts))


@query("t7_stream_changes", sql(TICKS + """
, h AS (SELECT *, lag(phase) OVER w AS pp, lag(velocity) OVER w AS pv FROM tm WINDOW w AS (PARTITION BY trend_id ORDER BY tick_at))
SELECT trend_id, epoch_us(tick_at) AS at_us, unnest(list_filter(['trend.upserted', CASE WHEN pp <> phase THEN 'trend.phase_changed' END,
  CASE WHEN velocity > 1.2 * pv THEN 'trend.velocity_spike' END], lambda x: x IS NOT NULL)) AS type FROM h"""))
def t7(spark, sf):
    t = ticks(spark, sf).select("trend_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "phase", "velocity")
    return in_landings(t, 3, "at_us", to_table(spark, lambda s: stateful.change_events(s, 1.2)))


@query("t8_stream_live_metrics", sql(f"""
, c AS (SELECT trend_id, source, (epoch_us(now) - CAST(floor(epoch_us(published_at) / {SCALE * 60_000_000}) AS BIGINT) * {SCALE * 60_000_000}) / {SCALE * 60e6} AS age FROM m, p)
SELECT trend_id, count(*) FILTER (age < 15) AS m15, count(*) FILTER (age < 30) AS m30, count(*) FILTER (age < 60) AS m60, CAST(count(DISTINCT source) FILTER (age < 60) AS INTEGER) AS sources60,
  round(count(*) FILTER (age < 15) / 15.0, 6) AS velocity FROM c GROUP BY 1"""))
def t8(spark, sf):
    s = stateful.live_metrics(stream(spark, sf), 60.0 * SCALE, epoch_micros(now_of(spark, sf)))
    out = ingest.last_per_key(ingest.run_to_table(s, "update"), ["trend_id"])
    return out.select("trend_id", "m15", "m30", "m60", "sources60", F.round("velocity", 6).alias("velocity"))


def _posts(spark, sf):
    """Mentions with their time in microseconds, for landings in its order."""
    return mentions(spark, sf).select("external_id", "trend_id", "source", "author_id", F.col("published_at").cast("timestamp").alias("published_at"),
                                      F.unix_micros(F.col("published_at").cast("timestamp")).alias("us"))


@query("t8_stream_decay", sql(f"""
, q AS (SELECT trend_id, source, CAST(floor(epoch_us(published_at) / {SCALE * 9e8}) AS BIGINT) AS d FROM m, p WHERE NOT (trend_id = 't3' AND published_at >= now - INTERVAL 12 DAY)),
w AS (SELECT max(CAST(floor(epoch_us(published_at) / 1000) AS BIGINT)) - 3600000 AS w FROM m, p WHERE NOT (trend_id = 't3' AND published_at >= now - INTERVAL 12 DAY)),
g AS (SELECT trend_id, unnest(range(min(d) + 1, max(d) + 6)) AS t FROM q GROUP BY 1),
c AS (SELECT g.trend_id, t, count(d) FILTER (d >= t - 1) AS m15, count(d) FILTER (d >= t - 2) AS m30, count(d) AS m60, count(DISTINCT source) AS sources60
  FROM g LEFT JOIN q ON q.trend_id = g.trend_id AND d < t AND d >= t - 4 GROUP BY ALL),
z AS (SELECT *, lag(m60) OVER (PARTITION BY trend_id ORDER BY t) AS before FROM c)
SELECT trend_id, t * {SCALE * 900_000_000} AS at_us, m15, m30, m60, CAST(sources60 AS INTEGER) AS sources60, round(m15 / 15.0, 6) AS velocity
FROM z, w WHERE t * {SCALE * 900_000} < w.w AND (m60 > 0 OR before > 0)"""))
def t8d(spark, sf):
    """Three landings; trend t3 falls silent and its rows fall to zero, reported by timers alone."""
    m = _posts(spark, sf).where(~((F.col("trend_id") == "t3") & (F.col("published_at") >= ts(now_of(spark, sf), -12 * 86400))))
    out = in_landings(m, 3, "us", to_table(spark, lambda s: timers.decaying_metrics(s, 60.0 * SCALE)))
    return out.select("trend_id", "at_us", "m15", "m30", "m60", "sources60", F.round("velocity", 6).alias("velocity"))


@query("t9_stream_clustering")
def t9(spark, sf):
    """Documents in three batches; equals the batch clustering of all of them."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    base = f"{shared_dir(spark)}/k-{uuid.uuid4().hex}"
    store = clustering.LeaderStore(spark, f"{base}/store")

    def run(s):
        s.writeStream.foreachBatch(store.assign).option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start().awaitTermination()
        return store.assignments()

    return in_landings(d, 3, "id", run)


#: Events as the log's query and its twins see them: three landings in order of time.
_LOG = """
, e AS (SELECT external_id, source AS type, epoch_us(published_at) - epoch_us(published_at) % 60000000 AS us FROM m),
s AS (SELECT min(us) AS lo, (max(us) - min(us) + 1) / 3.0 AS step FROM e),
lg AS (SELECT external_id, type, us // 1000 AS ts_ms, row_number() OVER (PARTITION BY us ORDER BY external_id) AS seq FROM e)"""


def _log_events(spark, sf):
    """Mentions as events; times are cut to the minute, so that events share milliseconds."""
    minute = F.unix_micros(F.col("published_at").cast("timestamp"))
    minute = minute - minute % 60_000_000
    return mentions(spark, sf).select(F.timestamp_micros(minute).alias("ts"), "external_id", F.col("source").alias("type"), minute.alias("us"))


def _log(spark, sf):
    return in_landings(_log_events(spark, sf), 3, "us", to_table(spark, timers.numbered_events))


@query("t10_stream_event_log", sql(_LOG + "SELECT external_id, type, ts_ms, seq, ts_ms || '-' || seq AS event_id FROM lg"))
def t10(spark, sf):
    """The event log over three landings, with its ids."""
    return _log(spark, sf)


@query("t10_replay_written_log", sql(_LOG + """
, tail AS (SELECT * FROM lg ORDER BY ts_ms DESC, seq DESC LIMIT 1000),
l AS (SELECT ts_ms, seq FROM tail ORDER BY ts_ms DESC, seq DESC LIMIT 1 OFFSET 300)
SELECT t.external_id, t.ts_ms || '-' || t.seq AS event_id, false AS needs_resync FROM tail t, l WHERE (t.ts_ms, t.seq) > (l.ts_ms, l.seq)"""))
def t10r(spark, sf):
    """A reader who has seen all but the last 300 events comes back and reads on from the written log."""
    log = _log(spark, sf)
    last = log.orderBy(F.desc("ts_ms"), F.desc("seq")).offset(300).limit(1).first()
    return ev.replay(log, last.ts_ms, last.seq).select("external_id", "event_id", "needs_resync")


@query("t10_stream_rate", sql(_LOG + """
, w AS (SELECT max(us) // 1000 - 3600000 AS w FROM e),
g AS (SELECT unnest(range(us // 1000 - us // 1000 % 21600000 - 64800000, us // 1000 + 1, 21600000)) AS start_ms, us FROM e)
SELECT start_ms, start_ms + 86400000 AS end_ms, count(*) AS events, round(count(*) / 86400.0, 9) AS per_second FROM g, w
WHERE us // 1000 >= start_ms AND us // 1000 < start_ms + 86400000 AND start_ms + 86400000 <= w.w GROUP BY ALL"""))
def t10s(spark, sf):
    """Events per second in sliding windows of a day, every six hours, given out as the watermark passes them."""
    out = in_landings(_log_events(spark, sf), 3, "us", to_table(spark, lambda s: timers.event_rate(s, "1 day", "6 hours")))
    return out.withColumn("per_second", F.round("per_second", 9))


@query("t13_stream_life_cycle", sql("""
, q AS (SELECT source || '/' || author_id AS key, epoch_us(published_at) AS us FROM m),
w AS (SELECT CAST(floor(max(us) / 1000) AS BIGINT) - 3600000 AS w FROM q),
g AS (SELECT *, lag(us) OVER (PARTITION BY key ORDER BY us) AS prev FROM q),
k AS (SELECT *, CASE WHEN prev IS NULL THEN 'new' WHEN us - prev > 6.048e11 THEN 'renewed' WHEN us - prev > 8.64e10 THEN 'reopened' END AS kind FROM g),
v AS (SELECT *, sum(CASE WHEN kind IN ('new', 'renewed') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY us) AS version, lead(us) OVER (PARTITION BY key ORDER BY us) AS next FROM k),
e AS (SELECT key, version, kind, us AS at_us FROM v WHERE kind IS NOT NULL
  UNION ALL SELECT key, version, 'archived', us + 86400000000 FROM v WHERE next IS NULL OR next - us > 8.64e10)
SELECT key, CAST(version AS BIGINT) AS version, kind, CAST(at_us AS BIGINT) AS at_us FROM e, w WHERE floor(at_us / 1000) < w"""))
def t13l(spark, sf):
    """Three landings; every class of transition, given out as the watermark passes it."""
    m = _posts(spark, sf).withColumn("key", F.concat_ws("/", "source", F.col("author_id").cast("string")))
    return in_landings(m, 3, "us", to_table(spark, lambda s: timers.life_cycle(s, "key")))


@query("j8_stream_pickup", sql("""
, x AS (SELECT a.trend_id, a.external_id, min(epoch_us(b.published_at) - epoch_us(a.published_at)) AS lag_us FROM m a JOIN m b
  ON a.trend_id = b.trend_id AND a.source = 'reddit' AND b.source = 'rss' AND b.published_at >= a.published_at AND b.published_at <= a.published_at + INTERVAL 1 HOUR GROUP BY ALL)
SELECT * FROM x"""))
def j8s(spark, sf):
    """Three landings in which every third post comes half a day late; a closing post of each side, ten days on, lets the last intervals end."""
    m = _posts(spark, sf).select("external_id", "trend_id", "source", "published_at", "us")
    m = m.withColumn("us", F.when(F.col("external_id") % 3 == 0, F.col("us") + 43_200_000_000).otherwise(F.col("us")))
    end = ts(now_of(spark, sf), 10 * 86400, "timestamp")
    last = m.agg(F.max("us").alias("us")).select(F.lit(-1).cast("bigint").alias("external_id"), F.lit("~end").alias("trend_id"), F.explode(F.array(F.lit("reddit"), F.lit("rss"))).alias("source"),
                                                 end.alias("published_at"), F.col("us"))
    return in_landings(m.unionByName(last), 3, "us", to_table(spark, lambda s: timers.pickup(s, "reddit", "rss", lateness="1 day"))).where("trend_id <> '~end'")


@query("t13_stream_sessions", sql("""
, g AS (SELECT author_id, published_at, epoch_us(published_at) - lag(epoch_us(published_at)) OVER (PARTITION BY author_id ORDER BY published_at) AS gap FROM m),
v AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 8.64e10 THEN 1 ELSE 0 END) OVER (PARTITION BY author_id ORDER BY published_at) AS s FROM g)
SELECT author_id, epoch_us(min(published_at)) AS start_us, count(*) AS mentions FROM v GROUP BY author_id, s"""))
def t13(spark, sf):
    """Complete mode: sessions still open at the end are part of the result."""
    s = stream(spark, sf)
    out = ingest.run_to_table(ingest.quiet_sessions(s, "author_id"), "complete")
    n = out.agg(F.max("batch_id")).scalar()
    return out.where(F.col("batch_id") == n).select("author_id", F.unix_micros("start").alias("start_us"), "mentions")
