"""Clusters, list views, joins and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import fmt, ts, within
from ..operators import clusters, graph, joins, reports, vectors, views
from .derived import (SAVED_SQL, RULES_SQL, TICKS, TREND_ROWS, posts_full, rules, saved, ticks, trend_rows)
from .early import TRENDS, scored
from .registry import query
from .text import N3
from .views import mentions, now_of, posts, posts_sql, sql, table
from .windowed import TS_SQL, scores_6h

FMT = "'%Y-%m-%d %H:%M:%S'"


@query("c3_c4_cluster_rollup", sql(posts_sql() + """
, pl AS (SELECT po.*, d.lang FROM po JOIN documents d USING (doc_id)),
rc AS (SELECT trend_id, text, row_number() OVER (PARTITION BY trend_id ORDER BY published_at DESC, external_id DESC) AS rn FROM pl),
ti AS (SELECT trend_id, first(trim(text) ORDER BY length(trim(text)), rn) AS title FROM rc WHERE rn <= 3 AND length(trim(text)) > 0 GROUP BY 1),
ss AS (SELECT trend_id, source, count(*) AS n, min((published_at, external_id)) AS f FROM pl GROUP BY ALL),
mx AS (SELECT trend_id, string_agg(source, ',' ORDER BY f) AS sources, first(source ORDER BY n DESC, f) AS primary_source,
   string_agg(source || '=' || n, ',' ORDER BY source) AS source_counts FROM ss GROUP BY 1)
SELECT trend_id, count(*) AS mentions, count(DISTINCT author_id) AS unique_authors, strftime(min(published_at), '%Y-%m-%d %H:%M:%S') AS first_seen,
  first(substr(text, 1, 200) ORDER BY length(text) DESC, published_at, external_id) AS summary, any_value(title) AS title, any_value(sources) AS sources,
  any_value(primary_source) AS primary_source, any_value(source_counts) AS source_counts,
  array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages, first(author_id ORDER BY published_at, external_id) AS originator
FROM pl JOIN ti USING (trend_id) JOIN mx USING (trend_id) GROUP BY trend_id"""))
def c3(spark, sf):
    return clusters.rollup(posts_full(spark, sf)).select(
        "trend_id", "mentions", "unique_authors", fmt(F.col("first_seen")).alias("first_seen"), "summary", "title",
        F.array_join("sources", ",").alias("sources"), "primary_source",
        F.array_join(F.transform(F.map_entries("source_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("source_counts"),
        F.array_join("languages", ",").alias("languages"), F.col("originator.author").alias("originator"))


def _checks(spark, sf):
    """Centroids per label over the even and over the odd vectors: two checks."""
    e = table(spark, sf, "embeddings").withColumn("check_no", (F.col("vec_id") % 2).cast("int"))
    e = e.withColumn("k", F.col("label") + F.col("check_no") * 100)
    c = vectors.centroids(e, "k")
    born = e.groupBy("k").agg(F.min("vec_id").alias("born"))
    return c.join(born, "k").select(F.floor(F.col("k") / 100).cast("int").alias("check_no"), (F.col("k") % 100).cast("bigint").alias("id"), "born", "centroid")


@query("c6_merge_detection", """
WITH v AS (SELECT vec_id % 2 AS check_no, label, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT check_no, label, pos, avg(x) AS x FROM v GROUP BY ALL),
a AS (SELECT check_no, CAST(label AS BIGINT) AS id, list(x ORDER BY pos) AS c FROM c GROUP BY ALL),
b AS (SELECT CAST(label AS BIGINT) AS id, min(vec_id) AS born FROM embeddings GROUP BY 1),
p AS (SELECT x.check_no, x.id AS a, y.id AS b FROM a x JOIN a y ON x.check_no = y.check_no AND x.id < y.id WHERE list_cosine_similarity(x.c, y.c) >= 0.0)
SELECT a, b, CAST(1 AS INTEGER) AS check_no, CASE WHEN ba.born <= bb.born THEN a ELSE b END AS survivor
FROM (SELECT a, b FROM p GROUP BY ALL HAVING count(*) = 2) JOIN b ba ON ba.id = a JOIN b bb ON bb.id = b""")
def c6(spark, sf):
    """Cosine 0.0 instead of 0.85: the labels of the tables are unrelated."""
    return clusters.merge_pairs(_checks(spark, sf), 0.0)


@query("c8_t13_life_cycle", sql("""
, q AS (SELECT source || '/' || author_id AS key, published_at, external_id FROM m),
g AS (SELECT *, epoch_us(published_at) - lag(epoch_us(published_at)) OVER (PARTITION BY key ORDER BY published_at) AS gap FROM q),
v AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 6.048e11 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY published_at) AS version FROM g)
SELECT key, CAST(version AS BIGINT) AS version, epoch_us(min(published_at)) AS start_us, epoch_us(max(published_at)) AS end_us, count(*) AS mentions,
  count(*) FILTER (gap > 8.64e10 AND gap <= 6.048e11) AS reopened FROM v GROUP BY ALL"""))
def c8(spark, sf):
    m = mentions(spark, sf).select(F.concat_ws("/", "source", F.col("author_id").cast("string")).alias("key"), "published_at", "external_id")
    return clusters.life_cycle(m, "key")


@query("c9_garbage", sql("""
, c AS (SELECT community || '/' || author_id AS id, max(published_at) AS last_seen, count(*) AS mentions FROM m GROUP BY 1)
SELECT id, mentions FROM c, p WHERE last_seen < now - INTERVAL 6 HOUR AND mentions < 3"""))
def c9(spark, sf):
    c = mentions(spark, sf).groupBy(F.concat_ws("/", "community", F.col("author_id").cast("string")).alias("id")).agg(
        F.max("published_at").alias("last_seen"), F.count("*").alias("mentions"))
    return clusters.garbage(c, now_of(spark, sf)).select("id", "mentions")


@query("c7_fork_detection")
def c7(spark, sf):
    """Per label of the vectors: modularity of the Louvain communities of its own similarity graph and the size of the part that forks off.

    Cosine 0.2 instead of 0.78: the vectors of a label are only loosely alike.
    """
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("bigint").alias("cluster"))
    f = graph.forks_of_vectors(e, 0.2)
    return f.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.first("modularity"), 6).alias("modularity"), F.first("split").alias("split"),
                                    F.count_if(F.col("version") == 2).alias("forked"))


@query("c7_modularity_of_labels", """
, c AS (SELECT vec_id AS src, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS dst FROM embeddings),
e AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, 1.0 + label AS w FROM c JOIN embeddings ON vec_id = src WHERE src <> dst),
l AS (SELECT e.*, a.label AS ls, b.label AS ld FROM e JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst),
t AS (SELECT 2 * sum(w) AS m FROM l),
d AS (SELECT label, sum(w) AS deg, sum(CASE WHEN same THEN w ELSE 0 END) AS inn FROM (SELECT ls AS label, w, ls = ld AS same FROM l UNION ALL SELECT ld, w, ls = ld FROM l) GROUP BY 1)
SELECT round(CAST(sum(inn / m - (deg / m) * (deg / m)) AS DOUBLE), 6) AS modularity FROM d, t""".replace(", c AS", "WITH c AS", 1))
def c7m(spark, sf):
    v = table(spark, sf, "embeddings")
    n = v.agg(F.count("*")).scalar()
    e = v.select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + 3) % n).alias("dst"), (1.0 + F.col("label")).alias("w")).where("src <> dst")
    e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").distinct()
    return graph.modularity(e, v.select(F.col("vec_id").alias("id"), F.col("label").alias("label"))).withColumn("modularity", F.round("modularity", 6))


@query("c11_refresh_due", sql("""
, cur AS (SELECT trend_id AS id, count(*) AS mentions, [avg(sentiment) + 2, avg(bot_score), avg(author_quality)] AS c FROM m GROUP BY 1),
old AS (SELECT trend_id AS id, count(*) AS mentions, [avg(bot_score), avg(author_quality), avg(sentiment) + 2] AS c FROM m, p WHERE published_at <= now - INTERVAL 20 HOUR AND trend_id <> 't3' GROUP BY 1)
SELECT id, old.id IS NULL AS is_new, cur.mentions - coalesce(old.mentions, 0) AS new_mentions, round(1 - list_cosine_similarity(cur.c, old.c), 6) AS drift,
  old.id IS NULL OR cur.mentions - old.mentions > 20 OR 1 - list_cosine_similarity(cur.c, old.c) > 0.4 AS due FROM cur LEFT JOIN old USING (id)"""))
def c11(spark, sf):
    m, now = mentions(spark, sf), now_of(spark, sf)
    a = [F.avg("sentiment") + 2, F.avg("bot_score"), F.avg("author_quality")]
    cur = m.groupBy(F.col("trend_id").alias("id")).agg(F.count("*").alias("mentions"), F.array(*a).alias("centroid"))
    old = m.where((F.col("published_at") <= ts(now, -20 * 3600)) & (F.col("trend_id") != "t3")).groupBy(F.col("trend_id").alias("id")).agg(
        F.count("*").alias("mentions"), F.array(a[1], a[2], a[0]).alias("centroid"))
    r = clusters.refresh_due(cur, old)
    return r.withColumn("drift", F.when(~F.col("is_new"), F.round("drift", 6)))


@query("c11_title_sources", sql("""
, w AS (SELECT trend_id, external_id, author_quality * exp(-(epoch_us(now) - epoch_us(published_at)) / 3.6e9 / 6) AS weight FROM m, p),
r AS (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY weight DESC, external_id) AS rank FROM w)
SELECT trend_id, external_id, CAST(rank AS INTEGER) AS rank, round(weight, 6) AS weight FROM r WHERE rank <= 5"""))
def c11t(spark, sf):
    return clusters.title_sources(mentions(spark, sf), now_of(spark, sf)).withColumn("weight", F.round("weight", 6))


# ---- list views --------------------------------------------------------------------------
@query("p8_trend_list", sql(TREND_ROWS + """
SELECT trend_id, round(score, 2) AS score, phase FROM tr WHERE list_contains(string_split(sources, ','), 'x') AND score >= 10
  AND (contains(lower(title), 'rumor') OR contains(lower(summary), 'rumor')) ORDER BY score DESC, trend_id LIMIT 30"""))
def p8(spark, sf):
    return views.list_trends(trend_rows(spark, sf), source="x", min_score=10, q="Rumor").select("trend_id", F.round("score", 2).alias("score"), "phase")


VIEW = TREND_ROWS + """
, vw0 AS (SELECT tr.*, p.now, CAST(CASE phase WHEN 'rising' THEN floor(velocity * 10 + 0.5) WHEN 'decaying' THEN -floor(velocity * 5 + 0.5)
    WHEN 'peaked' THEN floor(velocity * 2 + 0.5) ELSE 0 END AS BIGINT) AS delta,
    greatest(1, CAST(floor((epoch_us(p.now) - epoch_us(first_seen)) / 6e7 + 0.5) AS BIGINT)) AS mins,
    CASE WHEN sources = 'github' THEN 'Tendencia técnica · Desarrollo' WHEN sources IN ('hn', 'github,hn') THEN 'Tendencia técnica' ELSE '' END AS tech,
    CASE phase WHEN 'forming' THEN 'Señal emergente' WHEN 'rising' THEN 'Crecimiento acelerado' WHEN 'peaked' THEN 'En pico' ELSE 'En desaceleración' END AS lab FROM tr, p),
vw AS (SELECT trend_id, title, primary_source AS source, CASE primary_source WHEN 'reddit' THEN 'hot' WHEN 'x' THEN 'hot' WHEN 'bluesky' THEN 'cool' WHEN 'hn' THEN 'cool'
    WHEN 'rss' THEN 'muted' ELSE 'mint' END AS tone, CASE WHEN tech = '' THEN lab ELSE tech || ' · ' || lab END AS status,
  CASE WHEN delta > 5 THEN 'up' WHEN delta < -5 THEN 'down' ELSE 'flat' END AS dir, strftime(last_seen, '%H:%M') AS time,
  CASE WHEN score >= 70 THEN 'Muy caliente' WHEN score >= 50 THEN 'Caliente' WHEN score >= 30 THEN 'Templado' ELSE 'Enfriándose' END AS heat,
  CAST(floor(score + 0.5) AS BIGINT) AS confidence, mentions, delta, shape, substr(summary, 1, 180) || CASE WHEN length(summary) > 180 THEN '…' ELSE '' END AS why,
  CAST(floor(velocity * 60 + 0.5) AS BIGINT) || '/h;' || unique_sources || ';' || CASE WHEN mins < 60 THEN mins || 'min' ELSE CAST(floor(mins / 60.0 + 0.5) AS BIGINT) || 'h' END AS evidence,
  phase, last_seen, first_seen, velocity, unique_authors, penalty, score, sources FROM vw0)"""


def view(spark, sf):
    return views.trend_view(trend_rows(spark, sf), now_of(spark, sf))


@query("p10_p14_trend_view", sql(VIEW + "SELECT trend_id, title, source, tone, status, dir, time, heat, confidence, mentions, delta, shape, why, evidence FROM vw"))
def p10(spark, sf):
    ev = F.array_join(F.transform("evidence", lambda e: e["value"]), ";")
    return view(spark, sf).select("trend_id", "title", "source", "tone", "status", "dir", "time", "heat", "confidence", "mentions", "delta", "shape", "why", ev.alias("evidence"))


@query("p9_extended_filter", sql(VIEW + """
SELECT trend_id, tone, shape, dir, confidence FROM (SELECT * FROM vw, p WHERE shape = 'flat' AND vw.last_seen > p.now - INTERVAL 24 HOUR ORDER BY score DESC, trend_id LIMIT 50)"""))
def p9(spark, sf):
    v = view(spark, sf)
    return views.list_trends(v, shape="flat", seen_after=ts(now_of(spark, sf), -86400), limit=50).select("trend_id", "tone", "shape", "dir", "confidence")


@query("p21_reliability", sql(TRENDS + "SELECT trend_id, CASE WHEN floor(score + 0.5) > 70 THEN 'Alta' WHEN floor(score + 0.5) >= 40 THEN 'Media' ELSE 'Baja' END AS reliability FROM sc"))
def p21(spark, sf):
    from ..functions.numeric import js_round

    return scored(spark, sf).select("trend_id", views.reliability(js_round(F.col("score"))).alias("reliability"))


@query("p11_saved_list", sql(VIEW + SAVED_SQL + """
SELECT 'pinned' AS folder, trend_id, mentions FROM saved JOIN vw USING (trend_id) WHERE pinned
UNION ALL SELECT 'none', trend_id, mentions FROM saved JOIN vw USING (trend_id) WHERE coalesce(folder, '') = ''
UNION ALL SELECT 'ai:topic', trend_id, mentions FROM saved JOIN vw USING (trend_id) WHERE folder = 'ai' AND (contains(lower(title), 'topic1') OR contains(lower(status), 'topic1') OR contains(lower(coalesce(notes, '')), 'topic1'))"""))
def p11(spark, sf):
    v, s = view(spark, sf), saved(spark)
    out = None
    for name, folder, q in (("pinned", "pinned", None), ("none", "none", None), ("ai:topic", "ai", "Topic1")):
        part = views.saved_list(s, v, folder, q).select(F.lit(name).alias("folder"), "trend_id", "mentions")
        out = part if out is None else out.unionByName(part)
    return out


@query("p13_event_filter", sql("""
SELECT external_id, source FROM m, p WHERE source IN ('reddit', 'hn') AND trend_id = 't2' AND published_at > now - INTERVAL 7 DAY"""))
def p13(spark, sf):
    from ..streaming.events import filter_events

    e = mentions(spark, sf).withColumn("topic", F.col("trend_id"))
    return filter_events(e, types=["reddit", "hn"], type_col="source", topics=["t2"], topic_col="topic", since=ts(now_of(spark, sf), -7 * 86400), ts_col="published_at").select("external_id", "source")


@query("p16_engine_log", sql("""
SELECT external_id AS id, source AS engine, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS logged_at FROM m WHERE source = 'hn' ORDER BY published_at DESC, external_id DESC LIMIT 200"""))
def p16(spark, sf):
    m = mentions(spark, sf)
    log = m.select(F.col("external_id").alias("id"), F.col("source").alias("engine"), F.when(F.col("source") == "hn", "error").otherwise("info").alias("level"), F.col("published_at").alias("logged_at"))
    return views.engine_log(log, "error").select("id", "engine", fmt(F.col("logged_at")).alias("logged_at"))


@query("p1_event_time_gate", sql("""
, g AS (SELECT external_id, CASE WHEN external_id % 9 = 0 THEN NULL WHEN external_id % 7 = 0 THEN now + INTERVAL 6 MINUTE ELSE published_at END AS t, now FROM m, p)
SELECT CASE WHEN t IS NULL THEN 'unparsable' WHEN t > now + INTERVAL 5 MINUTE THEN 'future' WHEN t < now - INTERVAL 7 DAY THEN 'too_old' ELSE 'accepted' END AS verdict,
  count(*) AS n FROM g GROUP BY 1"""))
def p1(spark, sf):
    from ..sources.intake import event_time_gate

    now = now_of(spark, sf)
    i = F.col("external_id")
    raw = F.when(i % 9 == 0, "no date").when(i % 7 == 0, F.date_format(ts(now, 360), "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    g = event_time_gate(mentions(spark, sf).withColumn("raw", raw), "raw", now)
    return g.groupBy("verdict").agg(F.count("*").alias("n"))


@query("g8_briefing", sql(TREND_ROWS + """
, l AS (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY published_at DESC, external_id DESC) AS rank FROM po),
t5 AS (SELECT trend_id, string_agg(source || ':' || external_id, ',' ORDER BY rank) AS evidence_ids,
   max(CASE WHEN rank = 1 THEN source END) AS hs, max(CASE WHEN rank = 1 THEN substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200) END) AS quote FROM l WHERE rank <= 5 GROUP BY 1),
x AS (SELECT *, replace(sources, ',', ', ') AS srcs, CAST(floor(velocity * 60 + 0.5) AS BIGINT) AS hourly, sources IN ('hn', 'github', 'github,hn') AS tech FROM tr JOIN t5 USING (trend_id))
SELECT trend_id, CASE WHEN tech THEN 'Señal técnica emergiendo en ' ELSE 'Narrativa ganando tracción en ' END || srcs || ': ' || title || '. ' || hourly || ' menciones/hora en ventana de 15min. '
   || mentions || ' menciones totales de ' || unique_authors || ' autores. Fase: ' || phase || '. Fuente reciente (' || hs || '): "' || quote || '"' AS narrative,
  hourly || ' menc/hora (15min)|' || mentions || ' menciones · ' || unique_authors || ' autores|Fuentes: ' || srcs || '|Score: ' || printf('%.1f', score) || '/100|'
   || CASE WHEN tech THEN 'Tendencia técnica (sin respaldo social aún)' ELSE 'Respaldado por redes sociales' END AS key_points,
  concat_ws('|', CASE WHEN penalty > 0.4 THEN 'Spam/bot detectado' END, CASE WHEN penalty >= 0.3 AND penalty < 0.4 THEN 'Posible bot' END, CASE WHEN velocity > 5 THEN 'Velocidad anómala' END,
    CASE WHEN phase = 'decaying' THEN 'En desaceleración' END, CASE WHEN tech AND unique_sources = 1 THEN 'Fuente única — baja corroboración' END) AS risk_flags,
  round(greatest(0.2, least(0.95, score / 100)), 6) AS confidence, evidence_ids FROM x"""))
def g8(spark, sf):
    last = views.latest_mentions(posts(spark, sf), 5).withColumn("mention_id", F.concat_ws(":", "source", F.col("external_id").cast("string")))
    b = views.briefing(trend_rows(spark, sf), last)
    return b.select("trend_id", "narrative", F.array_join("key_points", "|").alias("key_points"), F.array_join("risk_flags", "|").alias("risk_flags"),
                    F.round("confidence", 6).alias("confidence"), F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query("n6_active_keywords", sql(TREND_ROWS + N3 + r"""
, tp AS (SELECT trend_id, title FROM tr, p WHERE last_seen > p.now - INTERVAL 24 HOUR AND score > 0 ORDER BY score DESC, trend_id LIMIT 5),
w AS (SELECT unnest(list_filter(regexp_split_to_array(regexp_replace(title, '[^a-zA-Z0-9\sáéíóúñü]', ' ', 'g'), '\s+'), lambda w: length(w) > 3)[1:4]) AS keyword FROM tp)
SELECT DISTINCT keyword FROM (SELECT keyword FROM w UNION ALL SELECT value FROM ce JOIN tp USING (trend_id) WHERE ord <= 3)"""))
def n6(spark, sf):
    from ..operators import mining

    top = views.trending(trend_rows(spark, sf), now_of(spark, sf), 5).join(mining.entity_lists(posts(spark, sf)), "trend_id")
    return mining.active_keywords(top)


# ---- joins ---------------------------------------------------------------------------------
@query("j2_saved_join", sql(TRENDS + SAVED_SQL + """
SELECT saved.trend_id, folder, pinned, mentions, round(score, 2) AS score FROM saved LEFT JOIN sc USING (trend_id)"""))
def j2(spark, sf):
    return joins.with_saved(scored(spark, sf), saved(spark)).select("trend_id", "folder", "pinned", "mentions", F.round("score", 2).alias("score"))


@query("j3_rules_for_trends", sql(TRENDS + RULES_SQL + """
SELECT rule_id, t.trend_id, round(t.score, 2) AS score FROM rules r JOIN sc t ON r.trend_id IS NULL OR r.trend_id = t.trend_id"""))
def j3(spark, sf):
    return joins.rules_for_trends(rules(spark), scored(spark, sf)).select("rule_id", "trend_id", F.round("score", 2).alias("score"))


@query("j4_followed", sql(TRENDS + SAVED_SQL + "SELECT trend_id, EXISTS (SELECT 1 FROM saved WHERE saved.trend_id = sc.trend_id) AS followed FROM sc"))
def j4(spark, sf):
    return joins.mark_followed(scored(spark, sf), saved(spark)).select("trend_id", "followed")


@query("j5_latest_score", sql(TS_SQL + f"""
SELECT trend_id, strftime(max(bucket_time), {FMT}) AS bucket, round(arg_max(score, bucket_time), 2) AS score, arg_max(mention_count, bucket_time) AS mention_count
FROM tsc, p WHERE bucket_time <= p.now - INTERVAL 3 DAY GROUP BY 1"""))
def j5(spark, sf):
    s = joins.latest_score(scores_6h(spark, sf), ts(now_of(spark, sf), -3 * 86400))
    return s.select("trend_id", fmt(F.col("bucket_time")).alias("bucket"), F.round("score", 2).alias("score"), "mention_count")


@query("j7_reference_expansion", """
, e AS (SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber AS ord FROM lineitem),
s AS (SELECT DISTINCT p_partkey AS id FROM part WHERE p_size <= 5),
u AS (SELECT src, dst, min(ord) AS ord FROM e WHERE src IN (SELECT id FROM s) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ord, dst) AS rn FROM u)
SELECT dst AS id, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS source_ids FROM r WHERE rn <= 3 AND dst NOT IN (SELECT id FROM s) GROUP BY 1""".replace(", e AS", "WITH e AS", 1))
def j7(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("ord"))
    s = table(spark, sf, "part").where("p_size <= 5").select(F.col("p_partkey").alias("id"))
    return joins.expand_references(e, s, 3).select("id", F.array_join("source_ids", ",").alias("source_ids"))


@query("j8_cross_source_pickup", sql("""
, x AS (SELECT a.trend_id, a.external_id, min(epoch_us(b.published_at) - epoch_us(a.published_at)) AS lag_us FROM m a JOIN m b
  ON a.trend_id = b.trend_id AND a.source = 'reddit' AND b.source = 'rss' AND b.published_at >= a.published_at AND b.published_at <= a.published_at + INTERVAL 1 HOUR GROUP BY ALL)
SELECT * FROM x"""))
def j8(spark, sf):
    return joins.pickup(mentions(spark, sf), "reddit", "rss")


@query("j9_orphan_rules", sql(TRENDS + RULES_SQL + "SELECT rule_id, trend_id FROM rules WHERE trend_id IS NOT NULL AND trend_id NOT IN (SELECT trend_id FROM sc)"))
def j9(spark, sf):
    return joins.orphan_rules(rules(spark), scored(spark, sf)).select("rule_id", "trend_id")


@query("j10_dimension_lookup", sql("""
, d AS (SELECT * FROM (VALUES ('x', 'social'), ('reddit', 'social'), ('bluesky', 'social'), ('rss', 'media'), ('gdelt', 'media'), ('hn', 'technical'), ('github', 'technical')) v(source, class))
SELECT trend_id, class, count(*) AS n FROM m JOIN d USING (source) GROUP BY ALL"""))
def j10(spark, sf):
    from ..params import MEDIA, SOCIAL, TECHNICAL

    rows = [(s, k) for k, names in (("social", SOCIAL), ("media", MEDIA), ("technical", TECHNICAL)) for s in names]
    dim = spark.createDataFrame(rows, "source string, class string")  # seven rows
    return mentions(spark, sf).join(F.broadcast(dim), "source").groupBy("trend_id", "class").agg(F.count("*").alias("n"))


@query("j11_enrichment", """
WITH b AS (SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS title, CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderstatus AS venue FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM b),
d AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS title, c_mktsegment AS venue, c_name || ' ' || c_mktsegment AS abstract FROM customer)
SELECT f.id, trim(coalesce(nullif(f.title, ''), nullif(d.title, ''))) AS title, f.year, coalesce(nullif(d.venue, ''), f.venue) AS venue, substr(trim(d.abstract), 1, 20) AS abstract
FROM f LEFT JOIN d USING (id) WHERE rn = 1 AND coalesce(nullif(f.title, ''), nullif(d.title, '')) IS NOT NULL""")
def j11(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    base = o.select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("title"),
                    F.year("o_orderdate").cast("string").alias("year"), F.col("o_orderstatus").alias("venue"))
    det = c.select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")).alias("title"), F.lit(None).cast("string").alias("year"),
                   F.col("c_mktsegment").alias("venue"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("abstract"))
    return joins.enrich(base, det, 20)


# ---- rankings and pages ----------------------------------------------------------------------
@query("w1_latest_mentions", sql("""
, r AS (SELECT trend_id, external_id, row_number() OVER (PARTITION BY trend_id ORDER BY published_at DESC, external_id DESC) AS rank FROM m)
SELECT trend_id, external_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""))
def w1(spark, sf):
    return views.latest_mentions(mentions(spark, sf), 10).select("trend_id", "external_id", "rank")


@query("w6_phase_changes", sql(TICKS + f"""
, h AS (SELECT *, lag(phase) OVER w AS fp, lag(velocity) OVER w AS pv FROM tm WINDOW w AS (PARTITION BY trend_id ORDER BY tick_at))
SELECT trend_id, strftime(tick_at, {FMT}) AS "at", fp AS from_phase, phase AS to_phase, round(velocity - pv, 6) AS velocity_change FROM h WHERE fp <> phase"""))
def w6(spark, sf):
    return views.phase_changes(ticks(spark, sf), t="at").select("trend_id", fmt(F.col("at")).alias("at"), "from_phase", "to_phase", F.round("velocity_change", 6).alias("velocity_change"))


@query("w7_ranked_by_score", sql(TRENDS + """
SELECT trend_id, round(score, 2) AS score, CAST(row_number() OVER (ORDER BY score DESC, trend_id) AS INTEGER) AS position FROM sc QUALIFY position <= 50"""))
def w7(spark, sf):
    return views.ranked(scored(spark, sf), "score", 50).select("trend_id", F.round("score", 2).alias("score"), "position")


@query("w8_keyset_page", sql(TRENDS + """
, f AS (SELECT trend_id, score FROM sc ORDER BY score DESC, trend_id LIMIT 3), c AS (SELECT min(score) AS s FROM f)
SELECT trend_id, round(score, 2) AS score, CAST(row_number() OVER (ORDER BY score DESC, trend_id) AS INTEGER) AS position, count(*) OVER () > 3 AS has_more
FROM (SELECT * FROM sc WHERE trend_id NOT IN (SELECT trend_id FROM f) ORDER BY score DESC, trend_id LIMIT 4) QUALIFY position <= 3"""))
def w8(spark, sf):
    s = scored(spark, sf)
    last = views.page(s, 3).orderBy(F.desc("position")).select("score", "trend_id").first()
    return views.page(s, 3, (last["score"], last["trend_id"])).select("trend_id", F.round("score", 2).alias("score"), "position", "has_more")


@query("w9_revived", sql(TICKS + f"""
, pk AS (SELECT trend_id, min(now) - INTERVAL 10 DAY AS peeked_at, trend_id = 't5' AS acted FROM m, p GROUP BY 1),
a AS (SELECT pk.trend_id, peeked_at, arg_max(phase, tick_at) AS phase_then FROM pk JOIN tm USING (trend_id) WHERE NOT acted AND tick_at <= peeked_at GROUP BY ALL),
n AS (SELECT trend_id, arg_max(phase, tick_at) AS phase_now FROM tm GROUP BY 1)
SELECT trend_id, phase_then, phase_now FROM a JOIN n USING (trend_id) WHERE phase_then <> phase_now ORDER BY peeked_at DESC, trend_id LIMIT 3"""))
def w9(spark, sf):
    t = ticks(spark, sf).withColumn("bucket_time", F.col("at"))
    peeks = mentions(spark, sf).select("trend_id").distinct().select("trend_id", ts(now_of(spark, sf), -10 * 86400).alias("peeked_at"), (F.col("trend_id") == "t5").alias("acted"))
    return views.revived(peeks, t).select("trend_id", "phase_then", "phase_now")


@query("w10_snoozed", sql(TRENDS + SAVED_SQL + """
SELECT trend_id, mentions, coalesce(snoozed_until > p.now, false) AS hidden, coalesce(snoozed_until <= p.now, false) AS woke_up FROM saved JOIN sc USING (trend_id), p"""))
def w10(spark, sf):
    return views.snoozed(saved(spark), now_of(spark, sf)).join(scored(spark, sf), "trend_id").select("trend_id", "mentions", "hidden", "woke_up")


@query("w14_conversations", sql(f"""
, r AS (SELECT *, external_id - external_id % 5 AS root FROM m)
SELECT root, count(*) AS posts, count(DISTINCT author_id) AS authors, CAST(sum(reach) AS BIGINT) AS reach, strftime(max(published_at), {FMT}) AS last_at
FROM r GROUP BY 1 ORDER BY max(published_at) DESC, root LIMIT 20"""))
def w14(spark, sf):
    m = mentions(spark, sf)
    r = graph.roots(m.select(F.col("external_id").alias("id"), F.col("reply_to").alias("parent")))
    return reports.conversations(m, r).withColumn("last_at", fmt(F.col("last_at")))


@query("w15_history_feed", sql(TICKS + f"""
, sp AS (SELECT trend_id, source, min(published_at) AS first_seen FROM m GROUP BY ALL),
so2 AS (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY first_seen, source) AS ord FROM sp),
h AS (SELECT *, lag(phase) OVER (PARTITION BY trend_id ORDER BY tick_at) AS fp FROM tm)
SELECT trend_id, strftime(first_seen, {FMT}) AS "at", CASE WHEN ord = 1 THEN 'detection' WHEN first_seen > ov THEN 'amplification' ELSE 'cross_source' END AS tag, source AS detail
  FROM so2 LEFT JOIN (SELECT trend_id, min(tick_at) AS ov FROM tm WHERE velocity > 2.5 GROUP BY 1) USING (trend_id)
UNION ALL SELECT trend_id, strftime(min(tick_at), {FMT}), 'threshold', '2.5' FROM tm WHERE velocity > 2.5 GROUP BY trend_id
UNION ALL SELECT trend_id, strftime(tick_at, {FMT}), 'phase', fp || '>' || phase FROM h WHERE fp <> phase"""))
def w15(spark, sf):
    t = ticks(spark, sf)
    ch = views.phase_changes(t, t="at").withColumnRenamed("at", "bucket_time")
    return reports.history_feed(reports.spread_order(mentions(spark, sf), now_of(spark, sf)), ch, t, 2.5).withColumn("at", fmt(F.col("at")))


@query("o1_o2_union_distinct", sql("""
SELECT trend_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM m GROUP BY 1"""))
def o1(spark, sf):
    m = mentions(spark, sf)
    from ..params import SOURCES
    from ..sources.intake import merge_sources

    parts = {s: m.where(F.col("source") == s) for s in SOURCES}
    u = merge_sources(parts)
    return u.groupBy("trend_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("o3_reconcile", sql(TRENDS + """
, o AS (SELECT trend_id FROM sc WHERE trend_id <> 't2'), n AS (SELECT trend_id, score FROM sc WHERE trend_id <> 't8' ORDER BY score DESC, trend_id LIMIT 7)
SELECT trend_id, CASE WHEN n.score IS NULL THEN 'removed' WHEN o.trend_id IS NULL THEN 'added' ELSE 'updated' END AS status, round(n.score, 2) AS score FROM o FULL JOIN n USING (trend_id)"""))
def o3(spark, sf):
    s = scored(spark, sf)
    return joins.reconcile(s.where("trend_id <> 't2'"), s.where("trend_id <> 't8'"), "trend_id", 7, "score").select(
        "trend_id", "status", F.round("score", 2).alias("score"))


@query("o4_membership", sql(TRENDS + SAVED_SQL + RULES_SQL + """
SELECT trend_id, trend_id IN (SELECT trend_id FROM saved) AS is_saved, trend_id IN (SELECT trend_id FROM rules WHERE armed AND trend_id IS NOT NULL) AS is_watched
FROM sc WHERE trend_id NOT IN (SELECT trend_id FROM saved, p WHERE snoozed_until > now)"""))
def o4(spark, sf):
    s = saved(spark)
    return joins.membership(scored(spark, sf), s, rules(spark).where("armed and trend_id is not null"), views.snoozed(s, now_of(spark, sf)).where("hidden")).select(
        "trend_id", "is_saved", "is_watched")
