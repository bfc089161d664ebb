"""Sources and sinks over payloads that Spark derives from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.times import fmt, ts
from ..operators import tables
from ..session import shared_dir
from ..sources import files, intake, payloads as pay, sinks
from ..streaming import events as ev
from .early import TRENDS, scored
from .registry import query
from .views import mentions, now_of, posts, posts_sql, sql, table
from .windowed import TS_SQL, scores_6h

FMT = "'%Y-%m-%d %H:%M:%S'"
PAGE = 25  # posts per payload, as in one answer of an API


def pages_of(df, item, wrap, order="external_id"):
    """Payloads of ``PAGE`` items each: JSON text of ``wrap(array of items)``."""
    p = df.select(F.floor(F.col(order) / PAGE).alias("page"), item.alias("i"), F.col(order).alias("o"))
    lists = p.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "i"))), lambda s: s["i"]).alias("items"))
    return lists.select("page", F.to_json(wrap(F.col("items"))).alias("payload"))


def xml_of(df, entry, head, tail, order="external_id"):
    p = df.select(F.floor(F.col(order) / PAGE).alias("page"), entry.alias("i"), F.col(order).alias("o"))
    lists = p.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "i"))), lambda s: s["i"]), "").alias("b"))
    return lists.select("page", F.concat(F.lit(head), "b", F.lit(tail)).alias("payload"))


def out(df):
    return df.select("source", "external_id", "author_id", "author_handle", F.sha1("text").alias("text_sha"), "language", fmt(F.col("published_at")).alias("published_at"), "url", "has_media")


def out_sql(where="true", **c):
    base = {"author_handle": "CAST(NULL AS VARCHAR)", "language": "'und'", "has_media": "false", "published_at": "published_at", **c}
    return sql(posts_sql() + f"""
SELECT '{base['source']}' AS source, {base['external_id']} AS external_id, {base['author_id']} AS author_id, {base['author_handle']} AS author_handle, sha1({base['text']}) AS text_sha,
  {base['language']} AS language, strftime({base['published_at']}, {FMT}) AS published_at, {base['url']} AS url, {base['has_media']} AS has_media FROM po WHERE {where}""")


# Column expressions are made on demand: they need a running session.
def I():  # noqa: E743
    return F.col("external_id")


def U():
    return F.col("author_id")


def T():
    return F.col("text")


def iso():
    return F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def name():
    return F.concat(F.lit("user"), U().cast("string"))


def reddit_pages(spark, sf):
    item = F.struct(F.struct(
        F.concat(F.lit("t3_"), I().cast("string")).alias("id"), F.when(I() % 13 == 0, "[deleted]").otherwise(name()).alias("author"), F.concat(F.lit("Title "), I().cast("string")).alias("title"),
        F.when(I() % 2 == 0, T()).otherwise("").alias("selftext"), F.unix_timestamp(F.col("published_at").cast("timestamp")).alias("created_utc"), F.col("url"),
        F.concat(F.lit("/r/x/"), I().cast("string")).alias("permalink"), (I() % 3 == 0).alias("is_video"), F.when(I() % 17 == 0, "moderator").alias("removed_by_category"),
        F.when(I() % 19 == 0, 1.0).alias("banned_at_utc")).alias("data"))
    return pages_of(posts(spark, sf), item, lambda a: F.struct(F.struct(a.alias("children")).alias("data")))


@query("s1_reddit_listing", out_sql(
    "external_id % 13 <> 0 AND external_id % 17 <> 0 AND external_id % 19 <> 0", source="reddit", external_id="'t3_' || external_id", author_id="'user' || author_id",
    author_handle="'u/user' || author_id", text="'Title ' || external_id || CASE WHEN external_id % 2 = 0 THEN chr(10) || chr(10) || text ELSE '' END", url="'https://www.reddit.com/r/x/' || external_id",
    has_media="external_id % 3 = 0"))
def s1(spark, sf):
    return out(pay.reddit_listing(reddit_pages(spark, sf)))


def atom_entry():
    n = I().cast("string")
    content = F.repeat(F.concat(T(), F.lit(" ")), F.lit(8))
    return F.concat(
        F.lit("<entry><id>t3_"), n, F.lit("</id><title>Title "), n, F.lit('</title><content type="html">&lt;p&gt;'), content,
        F.lit('&lt;/p&gt;</content><link href="https://r.test/'), n, F.lit('"/><author><name>'), name(),
        F.lit("</name></author><updated>"), iso(), F.lit("</updated></entry>"))


@query("s2_reddit_atom", out_sql(
    source="reddit", external_id="'t3_' || external_id", author_id="'user' || author_id", author_handle="'u/user' || author_id", url="'https://r.test/' || external_id",
    text="'Title ' || external_id || chr(10) || chr(10) || substr(trim(repeat(text || ' ', 8)), 1, 400)"))
def s2(spark, sf):
    return out(pay.reddit_atom(xml_of(posts(spark, sf), atom_entry(), '<feed xmlns="http://www.w3.org/2005/Atom">', "</feed>")))


@query("s3_bluesky", out_sql(
    "external_id % 11 <> 0", source="bluesky", external_id="'at://did/' || external_id", author_id="'did:' || author_id", author_handle="CASE WHEN external_id % 7 = 0 THEN 'did:' || author_id ELSE 'user' || author_id END",
    text="text", language="'en'", has_media="external_id % 3 = 0",
    url="'https://bsky.app/profile/' || CASE WHEN external_id % 7 = 0 THEN 'did:' || author_id ELSE 'user' || author_id END || '/post/' || external_id"))
def s3(spark, sf):
    did = F.concat(F.lit("did:"), U().cast("string"))
    rec = F.struct(T().alias("text"), iso().alias("createdAt"), F.array(F.lit("en")).alias("langs"), F.when(I() % 3 == 0, "x").alias("embed"))
    post = F.struct(F.concat(F.lit("at://did/"), I().cast("string")).alias("uri"), F.struct(did.alias("did"), F.when(I() % 7 != 0, name()).alias("handle")).alias("author"), F.when(I() % 11 != 0, rec).alias("record"))
    p = posts(spark, sf)
    found = pages_of(p.where(I() % 2 == 0), post, lambda a: F.struct(a.alias("posts")))
    feed = pages_of(p.where(I() % 2 == 1), F.struct(post.alias("post")), lambda a: F.struct(a.alias("feed")))
    return out(pay.bluesky(found.unionByName(feed)))


def hn_payloads(spark, sf):
    item = F.struct(I().alias("id"), name().alias("by"), F.unix_timestamp(F.col("published_at").cast("timestamp")).alias("time"), F.when(I() % 11 != 0, F.concat(F.lit("T "), T())).alias("title"),
                    F.when(I() % 2 == 0, F.col("url")).alias("url"), F.when(I() % 3 == 0, F.concat(F.lit("<p>a &amp; b</p> "), I().cast("string"))).alias("text"), (I() % 21).alias("score"))
    return posts(spark, sf).select(F.to_json(item).alias("payload"))


_HN = dict(source="hn", external_id="CAST(external_id AS VARCHAR)", author_id="'user' || author_id", author_handle="'user/user' || author_id",
           url="CASE WHEN external_id % 2 = 0 THEN url ELSE 'https://news.ycombinator.com/item?id=' || external_id END")


@query("s4_hn_items", out_sql("external_id % 11 <> 0", **_HN, text="'T ' || text || CASE WHEN external_id % 3 = 0 THEN chr(10) || chr(10) || 'a & b ' || external_id ELSE '' END || CASE WHEN external_id % 2 = 0 THEN ' — ' || url ELSE '' END"))
def s4(spark, sf):
    return out(pay.hn_items(hn_payloads(spark, sf)))


@query("s4_hn_items_live", out_sql("external_id % 11 <> 0 AND external_id % 21 >= 10", **_HN, text="'T ' || text", language="'en'"))
def s4l(spark, sf):
    return out(pay.hn_items(hn_payloads(spark, sf), 10))


@query("s5_feeds", out_sql(
    source="rss", external_id="CASE WHEN external_id % 3 = 2 THEN 'urn:' || external_id WHEN external_id % 6 = 0 THEN 'g' || external_id ELSE 'https://f.test/' || external_id END", author_id="CASE WHEN external_id % 3 = 1 THEN 'unknown' ELSE 'user' || author_id END",
    author_handle="CASE WHEN external_id % 3 = 1 THEN NULL ELSE 'user' || author_id END", text="'Title ' || external_id || CASE WHEN external_id % 3 = 1 THEN '' ELSE ' — a & b ' || text END",
    published_at="CASE WHEN external_id % 3 = 1 THEN TIMESTAMP '1970-01-01' ELSE published_at END", url="'https://f.test/' || external_id"))
def s5(spark, sf):
    n = I().cast("string")
    link = F.concat(F.lit("https://f.test/"), n)
    body = F.concat(F.lit("&lt;b&gt;a &amp;amp; b&lt;/b&gt; "), T())
    rfc = F.concat(F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    rss = F.concat(F.lit("<item><title>Title "), n, F.lit("</title><description>"), body, F.lit("</description><link>"), link, F.lit("</link>"),
                   F.when(I() % 6 == 0, F.concat(F.lit('<guid isPermaLink="false">g'), n, F.lit("</guid>"))).otherwise(""), F.lit("<pubDate>"), rfc, F.lit("</pubDate><author>"), name(), F.lit("</author></item>"))
    rdf = F.concat(F.lit("<item><title><![CDATA[Title "), n, F.lit("]]></title><link>"), link, F.lit("</link><pubDate>bad date</pubDate></item>"))
    atom = F.concat(F.lit("<entry><id>urn:"), n, F.lit("</id><title>Title "), n, F.lit("</title><summary>"), body, F.lit('</summary><link href="'), link, F.lit('"/><author><name>'), name(),
                    F.lit("</name></author><published>"), iso(), F.lit("</published></entry>"))
    p = posts(spark, sf)
    a = xml_of(p.where(I() % 3 == 0), rss, '<rss version="2.0"><channel><title>c</title>', "</channel></rss>")
    b = xml_of(p.where(I() % 3 == 1), rdf, '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">', "</rdf:RDF>")
    c = xml_of(p.where(I() % 3 == 2), atom, '<feed xmlns="http://www.w3.org/2005/Atom">', "</feed>")
    return out(pay.feeds(a.unionByName(b).unionByName(c)))


@query("s6_gdelt", out_sql(
    "CAST(floor(external_id / 25) AS BIGINT) % 4 <> 3", source="gdelt", external_id="'https://g.test/' || external_id", author_id="CASE WHEN external_id % 7 = 0 THEN 'unknown' ELSE 'd' || author_id END",
    author_handle="CASE WHEN external_id % 7 = 0 THEN 'unknown' ELSE 'd' || author_id END",
    text="text || ' — ' || CASE WHEN external_id % 9 = 0 THEN 'garbage' ELSE strftime(published_at, '%Y%m%dT%H%M%SZ') END", language="'English'",
    published_at="CASE WHEN external_id % 9 = 0 THEN TIMESTAMP '1970-01-01' ELSE published_at END", url="'https://g.test/' || external_id"))
def s6(spark, sf):
    item = F.struct(F.concat(F.lit("https://g.test/"), I().cast("string")).alias("url"), T().alias("title"), F.when(I() % 9 == 0, "garbage").otherwise(F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'")).alias("seendate"),
                    F.when(I() % 7 != 0, F.concat(F.lit("d"), U().cast("string"))).alias("domain"), F.lit("English").alias("language"))
    p = pages_of(posts(spark, sf), item, lambda a: F.struct(a.alias("articles")))
    return out(pay.gdelt(p.select(F.when(F.col("page") % 4 == 3, "<html>busy</html>").otherwise(F.col("payload")).alias("payload"))))


def repo_payloads(spark, sf):
    day = lambda n: F.date_format(F.col("published_at") - F.make_interval(days=n), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.struct(I().alias("id"), F.concat(F.lit("o/r"), I().cast("string")).alias("full_name"), F.when(I() % 5 != 0, T()).alias("description"), F.col("url").alias("html_url"), day((I() % 40).cast("int")).alias("created_at"),
                    iso().alias("pushed_at"), iso().alias("updated_at"), (480 + I() % 41).alias("stargazers_count"), F.when(I() % 2 == 0, "Python").alias("language"), F.struct(name().alias("login")).alias("owner"))
    return pages_of(posts(spark, sf), item, lambda a: F.struct(a.alias("items")))


_GH = dict(source="github", external_id="CAST(external_id AS VARCHAR)", author_id="'user' || author_id", author_handle="'user' || author_id",
           text="'o/r' || external_id || ': ' || CASE WHEN external_id % 5 <> 0 THEN text ELSE '' END", language="CASE WHEN external_id % 2 = 0 THEN 'Python' ELSE 'und' END", url="url")


@query("s7_github", out_sql(**_GH))
def s7(spark, sf):
    return out(pay.github(repo_payloads(spark, sf)))


@query("s7_github_live", out_sql("""480 + external_id % 41 >= 500 AND date_trunc('second', published_at) >= (SELECT now FROM p) - INTERVAL 2 DAY
  AND date_trunc('second', published_at) - to_days(CAST(external_id % 40 AS INTEGER)) >= (SELECT now FROM p) - INTERVAL 30 DAY""", **_GH))
def s7l(spark, sf):
    return out(pay.github(repo_payloads(spark, sf), now_of(spark, sf)))


@query("s8_x_search", out_sql("external_id % 11 <> 0", source="x", external_id="CAST(external_id AS VARCHAR)", author_id="CASE WHEN external_id % 7 = 0 THEN 'unknown' ELSE CAST(author_id AS VARCHAR) END", text="text",
                              language="CASE WHEN external_id % 2 = 0 THEN 'en' ELSE 'und' END", url="'https://x.com/i/web/status/' || external_id"))
def s8(spark, sf):
    item = F.struct(I().cast("string").alias("id"), F.when(I() % 11 != 0, T()).alias("text"), F.when(I() % 7 != 0, U().cast("string")).alias("author_id"), iso().alias("created_at"), F.when(I() % 2 == 0, "en").alias("lang"))
    return out(pay.x_search(pages_of(posts(spark, sf), item, lambda a: F.struct(a.alias("data")))))


@query("s9_profile_html", sql(posts_sql() + """
, q AS (SELECT *, external_id // 10 AS page, row_number() OVER (PARTITION BY external_id // 10 ORDER BY external_id) AS n FROM po WHERE external_id % 5 <> 4)
SELECT CAST(external_id AS VARCHAR) AS external_id, 'user' || author_id AS author_id, sha1('a & ' || text) AS text_sha FROM q WHERE n <= 8"""))
def s9(spark, sf):
    """Pages of ten posts; every fifth block is too short and carries no link."""
    full = F.concat(F.lit('<div class="tweet-content media" dir="auto"><b>a</b> &amp; '), T(), F.lit('</div><a href="/'), name(), F.lit("/status/"), I().cast("string"), F.lit('">x</a>'))
    block = F.when(I() % 5 == 4, '<div class="tweet-content">short</div>').otherwise(full)
    p = posts(spark, sf).select(F.floor(I() / 10).alias("page"), I().alias("o"), block.alias("b"))
    html = p.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "b"))), lambda s: s["b"]), "\n").alias("html"))
    return pay.x_profile_html(html, now_of(spark, sf)).select("external_id", "author_id", F.sha1("text").alias("text_sha"))


@query("s9_page_blocks", r"""
SELECT page_id, len(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1)) AS blocks FROM pages""")
def s9p(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1))).cast("bigint").alias("blocks"))


def bulk(spark, sf):
    return posts(spark, sf).select(
        F.when(I() % 12 == 0, "myspace").otherwise(F.col("source")).alias("source"), F.when(I() % 14 == 0, "").otherwise(I().cast("string")).alias("external_id"), F.when(I() % 3 != 0, U().cast("string")).alias("author_id"),
        F.when(I() % 10 == 0, "abcd").otherwise(T()).alias("text"), F.when(I() % 4 != 0, "en").alias("language"), F.when(I() % 6 != 0, F.col("published_at")).alias("published_at"))


@query("s10_bulk_intake", sql(posts_sql() + f"""
SELECT CASE WHEN external_id % 12 = 0 THEN 'unknown_source' WHEN external_id % 10 = 0 THEN 'short_text' WHEN external_id % 14 = 0 THEN 'no_external_id' ELSE 'accepted' END AS verdict,
  CASE WHEN external_id % 3 <> 0 THEN CAST(author_id AS VARCHAR) ELSE 'unknown' END AS author_id, CASE WHEN external_id % 4 <> 0 THEN 'en' ELSE 'und' END AS language,
  strftime(CASE WHEN external_id % 6 <> 0 THEN published_at ELSE now END, {FMT}) AS published_at FROM po, p"""))
def s10(spark, sf):
    good, bad = intake.bulk_intake(bulk(spark, sf), now_of(spark, sf))
    u = good.withColumn("reject_reason", F.lit("accepted")).unionByName(bad)
    return u.select(F.col("reject_reason").alias("verdict"), "author_id", "language", fmt(F.col("published_at")).alias("published_at"))


@query("s11_invariants", sql("""
SELECT external_id % 6 <> 0 AS ok_id, external_id % 5 <> 0 AS ok_time, external_id % 8 <> 0 AS ok_content, external_id % 9 <> 0 AS ok_language,
  external_id % 6 <> 0 AND external_id % 5 <> 0 AND external_id % 8 <> 0 AND external_id % 9 <> 0 AS valid, count(*) AS n FROM m GROUP BY ALL"""))
def s11(spark, sf):
    now = now_of(spark, sf)
    p = posts(spark, sf).select(
        F.when(I() % 6 == 0, "?").otherwise(F.concat_ws(":", "source", I().cast("string"))).alias("id"), "source", "external_id", "published_at",
        F.when(I() % 5 == 0, ts(now, 61)).otherwise(ts(now)).alias("fetched_at"), F.when(I() % 8 == 0, "  ").otherwise(T()).alias("text"), F.when(I() % 9 != 0, "en").alias("language"))
    return intake.check_invariants(p, now).groupBy("ok_id", "ok_time", "ok_content", "ok_language", "valid").agg(F.count("*").alias("n"))


@query("s12_merge_sources", sql("""
SELECT source, count(*) AS payloads, count(*) FILTER (external_id % 7 = 0) AS corrupt FROM m GROUP BY 1"""))
def s12(spark, sf):
    p = posts(spark, sf).select("source", F.when(I() % 7 == 0, "<oops").otherwise(F.to_json(F.struct("text"))).alias("payload"))
    return pay.corrupt_counts(p, "text string")


def scratch(spark):
    return f"{shared_dir(spark)}/q-{uuid.uuid4().hex}"


@query("s13_csv_scan", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def s13(spark, sf):
    path = scratch(spark)
    table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice").write.csv(path, header=True)
    return files.csv_table(spark, path, "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double")


@query("s14_a33_run_results", """
WITH r AS (SELECT l_returnflag AS config, l_linenumber AS run, count(*) FILTER (l_discount > 0.02) AS passed, count(*) AS total FROM lineitem GROUP BY ALL)
SELECT config, round(avg(passed / total), 4) AS mean, round(coalesce(stddev_samp(passed / total), 0), 4) AS stddev, round(min(passed / total), 4) AS min, round(max(passed / total), 4) AS max, count(*) AS runs FROM r GROUP BY 1""")
def s14(spark, sf):
    """Run results written as many JSON files and read back from their paths."""
    r = table(spark, sf, "lineitem").groupBy(F.lit(1).alias("eval"), F.col("l_returnflag").alias("config"), F.col("l_linenumber").alias("run")).agg(
        F.count_if(F.col("l_discount") > 0.02).alias("p"), F.count("*").alias("t"))
    path = scratch(spark)
    r.select("eval", "config", "run", F.struct((F.col("p") / F.col("t")).alias("pass_rate"), F.col("p").alias("passed"), (F.col("t") - F.col("p")).alias("failed"), F.col("t").alias("total")).alias("summary")).write.partitionBy("eval", "config", "run").json(path)
    return tables.run_statistics(files.run_results(spark, path, "*.json"), "config", "pass_rate")


# ---- sinks -------------------------------------------------------------------------------
@query("k1_snapshot_upsert", sql("""
SELECT trend_id, author_id, count(*) AS version, max(external_id) AS last_id FROM m GROUP BY ALL"""))
def k1(spark, sf):
    """Three batches of (trend, author) states, the second folded into a base; the third stays a delta merged on reading."""
    m, snap = mentions(spark, sf), sinks.Snapshot(spark, scratch(spark), "key", "version")
    for no, upto in enumerate((0.3, 0.6, 1.0)):
        part = m.where(I() <= m.agg((F.max("external_id") * upto).alias("x")).scalar())
        state = part.groupBy("trend_id", "author_id").agg(F.count("*").alias("version"), F.max("external_id").alias("last_id"))
        snap.upsert(state.withColumn("key", F.concat_ws("/", "trend_id", F.col("author_id").cast("string"))), no)
        if no == 1:
            snap.compact()
    return snap.read().select("trend_id", "author_id", "version", "last_id")


LOG_SQL = """
, lg AS (SELECT external_id, epoch_us(published_at) // 1000 AS ts_ms, row_number() OVER (PARTITION BY epoch_us(published_at) // 1000 ORDER BY external_id) AS seq FROM m),
tail AS (SELECT * FROM lg ORDER BY ts_ms DESC, seq DESC LIMIT 1000)"""


def log(spark, sf):
    return ev.with_event_id(mentions(spark, sf).select("external_id", F.col("published_at").alias("ts")), ["external_id"])


@query("k2_t10_event_replay", sql(LOG_SQL + """
, c AS (SELECT ts_ms, seq FROM tail ORDER BY ts_ms DESC, seq DESC LIMIT 1 OFFSET 300)
SELECT 'known' AS cursor, external_id, false AS needs_resync FROM tail, c WHERE (tail.ts_ms, tail.seq) > (c.ts_ms, c.seq)
UNION ALL SELECT 'gone', external_id, true FROM (SELECT * FROM tail ORDER BY ts_ms DESC, seq DESC LIMIT 50)"""))
def k2(spark, sf):
    e = log(spark, sf)
    at = e.orderBy(F.desc("ts_ms"), F.desc("seq")).limit(301).orderBy("ts_ms", "seq").first()
    a = ev.replay(e, at["ts_ms"], at["seq"]).select(F.lit("known").alias("cursor"), "external_id", "needs_resync")
    return a.unionByName(ev.replay(e, 1, 1).select(F.lit("gone").alias("cursor"), "external_id", "needs_resync"))


@query("k3_bounded_history", sql(TS_SQL + f"""
SELECT trend_id, strftime(bucket_time, {FMT}) AS bucket, CAST(row_number() OVER (PARTITION BY trend_id ORDER BY bucket_time DESC) AS INTEGER) AS age_rank FROM tsc QUALIFY age_rank <= 20"""))
def k3(spark, sf):
    return sinks.bounded_history(scores_6h(spark, sf), 20).select("trend_id", fmt(F.col("bucket_time")).alias("bucket"), "age_rank")


@query("k5_retention", sql("""
, d AS (SELECT CAST(published_at AS DATE) AS day, CAST(now - INTERVAL 20 DAY AS DATE) AS cutoff FROM m, p)
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM d WHERE day >= cutoff GROUP BY 1"""))
def k5(spark, sf):
    m = mentions(spark, sf).withColumn("ingest_date", F.to_date("published_at"))
    return sinks.retained(m, "mentions", "ingest_date", now_of(spark, sf), 20).groupBy(F.date_format("ingest_date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("k5_expired_partitions", sql("""
SELECT DISTINCT strftime(published_at, '%Y-%m-%d') AS day FROM m, p WHERE CAST(published_at AS DATE) < CAST(now - INTERVAL 20 DAY AS DATE)"""))
def k5e(spark, sf):
    m = mentions(spark, sf).withColumn("ingest_date", F.to_date("published_at"))
    return sinks.expired_partitions(m, "mentions", "ingest_date", now_of(spark, sf), 20).select(F.date_format("ingest_date", "yyyy-MM-dd").alias("day"))
