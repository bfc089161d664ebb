"""Text, entities and keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params
from ..functions import entities as ent
from ..functions import text as tx
from ..functions.times import fmt
from ..operators import mining
from .registry import query
from .views import _list, documents, mentions, now_of, posts, posts_sql, spread, sql, table

SP = tx.SPACE.replace("'", "''")
NSP = tx.NON_SPACE


def normalise_sql(col: str) -> str:
    out = f"coalesce({col}, '')"
    for pattern, to in tx.NORMALISE_STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    out = f"translate({out}, '{tx.DOT_MARK}{tx.DASH_MARK}', '.-')"
    return f"trim(regexp_replace(lower({out}), '{SP}+', ' ', 'g'))"


def tokens_sql(col: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({col}), 'https?://{NSP}+', ' ', 'g'), '{SP}+'), lambda t: length(t) > 0)"


def strip_html_sql(col: str) -> str:
    out = f"regexp_replace({col}, '<[^>]+>', ' ', 'g')"
    for entity, char in tx.HTML_ENTITIES:
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '{SP}+', ' ', 'g'))"


def entities_sql(col: str) -> str:
    parts = []
    for kind, pattern, group in ent.PATTERNS:
        ex = f"regexp_extract_all({col}, '{pattern}', {group})"
        if kind == "cve":
            ex = f"list_transform({ex}, lambda v: upper(v))"
        parts.append(f"list_transform({ex}, lambda v: '{kind}:' || v)")
    for kind, words in ent.DICTIONARIES:
        parts.append(f"list_transform(list_filter({_list(words)}, lambda w: regexp_matches({col}, '\\b' || w || '\\b')), lambda v: '{kind}:' || v)")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


@query("p2_p4_normalise_hash", f"""
SELECT doc_id, sha1({normalise_sql('text')}) AS text_hash, sha1(doc_id || '|' || {normalise_sql('text')}) AS content_hash,
  CAST(length({normalise_sql('text')}) AS INTEGER) AS n FROM documents""")
def p2(spark, sf):
    d = documents(spark, sf).select("doc_id", "text", tx.normalise(F.col("text")).alias("norm"))
    return d.select("doc_id", F.sha1("norm").alias("text_hash"),
                    F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), "norm")).alias("content_hash"), F.length("norm").alias("n"))


@query("p3_tokens", f"""
SELECT doc_id, CAST(len({tokens_sql('text')}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({tokens_sql('text')})) AS INTEGER) AS n_distinct,
  sha1(array_to_string(list_sort(list_distinct({tokens_sql('text')})), ' ')) AS set_hash FROM documents""")
def p3(spark, sf):
    d = documents(spark, sf)
    t = F.col("text")
    return d.select("doc_id", F.size(tx.tokens(t)).alias("n_tokens"), F.size(tx.token_set(t)).alias("n_distinct"),
                    F.sha1(F.array_join(tx.token_set(t), " ")).alias("set_hash"))


@query("p5_p18_ids_communities", sql("""
SELECT source || ':' || external_id AS mention_id, CASE source WHEN 'reddit' THEN 'r' || (external_id % 9) WHEN 'hn' THEN 'hn'
  WHEN 'bluesky' THEN 'e.test' WHEN 'rss' THEN 'e.test' ELSE source END AS community FROM m"""))
def p5(spark, sf):
    m = mentions(spark, sf)
    sub = F.concat(F.lit("R"), F.col("external_id") % 9)
    return m.select(tx.mention_id(F.col("source"), F.col("external_id")).alias("mention_id"),
                    tx.community(F.col("source"), F.col("url"), sub).alias("community"))


@query("p6_strip_html", f"SELECT page_id, sha1({strip_html_sql('html')}) AS text_hash, CAST(length({strip_html_sql('html')}) AS INTEGER) AS n FROM pages")
def p6(spark, sf):
    h = tx.strip_html(F.col("html"))
    return spread(table(spark, sf, "pages")).select("page_id", F.sha1(h).alias("text_hash"), F.length(h).alias("n"))


@query("p7_parse_dates", """
SELECT event_id, strftime(CASE WHEN event_id % 5 = 4 THEN TIMESTAMP '1970-01-01' ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS parsed FROM events""")
def p7(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    raw = (F.when(i % 5 == 0, F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
           .when(i % 5 == 1, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
           .when(i % 5 == 2, F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"))
           .when(i % 5 == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("not a date"))
    return e.select("event_id", fmt(tx.parse_date(raw)).alias("parsed"))


@query("p12_relevance", f"""
, po2 AS (SELECT doc_id AS id, text FROM documents)
SELECT id, relevant FROM (SELECT id, list_bool_or(list_transform({_list(params.DOMAIN_KEYWORDS)}, lambda w: contains(lower(text), w)))
   OR list_bool_or(list_transform(['reationed', 'the'], lambda w: length(w) > 3 AND contains(lower(text), w))) AS relevant FROM po2)""".replace(", po2", "WITH po2", 1).replace("list_bool_or(", "list_aggregate(").replace("lower(text), w))) ", "lower(text), w)), 'bool_or') ").replace("contains(lower(text), w)))\n", "contains(lower(text), w)), 'bool_or')\n"))
def p12(spark, sf):
    return documents(spark, sf).select(
        F.col("doc_id").alias("id"), ent.is_relevant(F.col("text"), ["reationed", "the"]).alias("relevant"))


@query("p15_sanitise", """
WITH d AS (SELECT doc_id, '```json\n' || substr(text, 1, 40) || '``` `code` \\"q\\" <b>' || text || '</b>' AS t FROM documents)
SELECT doc_id, sha1(trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(t, '```(?:json)?[\\t\\n\\f\\r ]*([\\s\\S]*?)```', '\\1', 'g'),
  '`([^`]+)`', '\\1', 'g'), '\\"', '"'), '\\''', ''''), '<[^>]+>', '', 'g'), '{SP}+', ' ', 'g'))) AS clean_hash FROM d""".replace("{SP}", SP))
def p15(spark, sf):
    t = F.concat(F.lit("```json\n"), F.substring("text", 1, 40), F.lit('``` `code` \\"q\\" <b>'), F.col("text"), F.lit("</b>"))
    return documents(spark, sf).select("doc_id", F.sha1(tx.sanitise(t)).alias("clean_hash"))


@query("p17_mask_key", "SELECT c_custkey, substr(c_name, 1, 5) || '…' || right(c_name, 4) AS masked FROM customer")
def p17(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", tx.mask_key(F.col("c_name")).alias("masked"))


@query("p19_canonical_url", r"""
WITH b AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages),
h AS (SELECT *, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1) AS head FROM b)
SELECT page_id, lower(head) || regexp_replace(substr(u, length(head) + 1), '/+$', '') AS canonical,
  lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host FROM h""")
def p19(spark, sf):
    return spread(table(spark, sf, "pages")).select(
        "page_id", tx.canonical_url(F.col("url")).alias("canonical"), tx.url_host(F.col("url")).alias("host"))


@query("n1_n2_entities", sql(posts_sql() + f"""
, en AS (SELECT external_id, unnest(list_distinct({entities_sql('text')})) AS e FROM po)
SELECT external_id, count(*) AS n, string_agg(e, ' ' ORDER BY e) AS entities FROM en GROUP BY 1"""))
def n1(spark, sf):
    found = posts(spark, sf).select("external_id", ent.entity_array(F.col("text")).alias("e"))  # named, or the text is searched for each use
    e = F.col("e")
    flat = F.sort_array(F.transform(e, lambda x: F.concat_ws(":", x["type"], x["value"])))
    return found.select("external_id", F.size(e).cast("bigint").alias("n"), F.array_join(flat, " ").alias("entities"))


@query("n1_document_entities", f"""
WITH en AS (SELECT doc_id, unnest(list_distinct({entities_sql('text')})) AS e FROM documents)
SELECT split_part(e, ':', 1) AS type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM en GROUP BY 1""")
def n1d(spark, sf):
    d = documents(spark, sf).select("doc_id", F.explode(ent.entity_array(F.col("text"))).alias("e"))
    return d.groupBy(F.col("e.type").alias("type")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


N3 = f"""
, x AS (SELECT trend_id, external_id, published_at, generate_subscripts(l, 1) AS pos, unnest(l) AS e FROM (SELECT *, {entities_sql('text')} AS l FROM po)),
k AS (SELECT trend_id, split_part(e, ':', 1) AS type, lower(substr(e, strpos(e, ':') + 1)) AS key,
   arg_min(substr(e, strpos(e, ':') + 1), (published_at, external_id, pos)) AS value, min((published_at, external_id, pos)) AS o FROM x GROUP BY ALL),
ce AS (SELECT trend_id, CAST(ord AS INTEGER) AS ord, type, value FROM (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY o) AS ord FROM k) WHERE ord <= 20)"""


@query("n3_cluster_entities", sql(posts_sql() + N3 + "SELECT * FROM ce"))
def n3(spark, sf):
    return mining.cluster_entities(posts(spark, sf))


def _veto_sql(mode):
    out = []
    for kind in params.RIGID_TYPES:
        f = lambda s: f"list_distinct(list_filter({s}, lambda v: starts_with(v, '{kind}:')))"
        a, b = f("a"), f("b")
        if mode == "asymmetric":
            a, b = f"list_transform({a}, lambda v: lower(v))", f"list_transform({b}, lambda v: lower(v))"
            clash = f"len(list_filter({b}, lambda v: NOT list_contains({a}, v))) > 0"
        else:
            clash = f"(len(list_filter({b}, lambda v: NOT list_contains({a}, v))) > 0 OR len(list_filter({a}, lambda v: NOT list_contains({b}, v))) > 0)"
        out.append(f"(len({a}) > 0 AND len({b}) > 0 AND {clash})")
    return " OR ".join(out)


@query("n4_rigid_veto", sql(posts_sql() + f"""
, e AS (SELECT external_id, reply_to, {entities_sql('text')} AS l FROM po),
pr AS (SELECT c.external_id, p2.l AS a, c.l AS b FROM e c JOIN e p2 ON p2.external_id = c.reply_to)
SELECT external_id, {_veto_sql('set_inequality')} AS veto, {_veto_sql('asymmetric')} AS veto_asymmetric FROM pr"""))
def n4(spark, sf):
    e = posts(spark, sf).select("external_id", "reply_to", ent.entity_array(F.col("text")).alias("e"))
    parent = e.select(F.col("external_id").alias("reply_to"), F.col("e").alias("a"))
    pair = e.where("reply_to is not null").join(parent, "reply_to")
    return pair.select("external_id", ent.rigid_veto(F.col("a"), F.col("e")).alias("veto"),
                       ent.rigid_veto(F.col("a"), F.col("e"), "asymmetric").alias("veto_asymmetric"))


@query("n5_tags", sql(posts_sql() + N3 + """
SELECT trend_id, string_agg(value, ',' ORDER BY ord) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY trend_id ORDER BY ord) AS r FROM ce
  WHERE type IN ('brand', 'cashtag', 'hashtag')) WHERE r <= 5 GROUP BY 1"""))
def n5(spark, sf):
    return mining.entity_lists(posts(spark, sf)).select("trend_id", F.array_join(ent.tags(F.col("entities")), ",").alias("tags"))


@query("n7_harvest_handles", sql(posts_sql() + """
, h AS (SELECT published_at, lower(unnest(regexp_extract_all(text, '@([A-Za-z0-9_]{3,15})', 1))) AS handle FROM po WHERE source IN ('reddit', 'bluesky', 'hn'))
SELECT handle, count(*) AS mentions, strftime(max(published_at), '%Y-%m-%d %H:%M:%S') AS last_seen FROM h, p GROUP BY handle, now
HAVING max(published_at) > now - INTERVAL 192 HOUR ORDER BY max(published_at) DESC, handle LIMIT 30"""))
def n7(spark, sf):
    return mining.harvest_handles(posts(spark, sf), now_of(spark, sf), 192 * 3600.0).withColumn("last_seen", fmt(F.col("last_seen")))


@query("n7_top_handles", sql(posts_sql() + """
, h AS (SELECT published_at, lower(unnest(regexp_extract_all(text, '@([A-Za-z0-9_]{3,15})', 1))) AS handle FROM po WHERE source IN ('reddit', 'bluesky', 'hn')),
r AS (SELECT handle, count(*) AS mentions, max(published_at) AS l FROM h, p GROUP BY handle, now HAVING max(published_at) > now - INTERVAL 192 HOUR ORDER BY l DESC, handle LIMIT 30)
SELECT handle, mentions FROM r ORDER BY mentions DESC, handle LIMIT 3"""))
def n7t(spark, sf):
    return mining.top_handles(mining.harvest_handles(posts(spark, sf), now_of(spark, sf), 192 * 3600.0)).select("handle", "mentions")


@query("n8_top_tickers", sql(posts_sql() + r"""
, t AS (SELECT unnest(list_distinct(regexp_extract_all(text, '\$([A-Z]{1,5})\b', 1))) AS value FROM po)
SELECT value, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, value LIMIT 10"""))
def n8(spark, sf):
    return mining.top_entities(posts(spark, sf), "cashtag")


CLASSES = {"articles": ["the", "les", "der", "los"], "links": ["que", "und", "and"], "places": ["paris", "madrid"]}


@query("n9_keyword_vote", "WITH v AS (SELECT doc_id, " + ", ".join(
    " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words) + f" AS {name}" for name, words in CLASSES.items()) + """ FROM documents)
SELECT doc_id, CASE WHEN greatest(articles, links, places) = 0 THEN 'none' WHEN articles >= links AND articles >= places THEN 'articles'
  WHEN links >= places THEN 'links' ELSE 'places' END AS class FROM v""")
def n9(spark, sf):
    return documents(spark, sf).select("doc_id", ent.keyword_vote(F.col("text"), CLASSES, "none").alias("class"))


@query("n10_impact", sql(posts_sql() + """
SELECT external_id, CAST(least(10, CASE source WHEN 'x' THEN 6 WHEN 'reddit' THEN 5 WHEN 'hn' THEN 4 WHEN 'rss' THEN 3 ELSE 2 END
  + CASE WHEN regexp_matches(text, '(?i)breaking|just in|alert|urgent') THEN 2 ELSE 0 END + CASE WHEN reach > 300 THEN 2 ELSE 0 END) AS BIGINT) AS impact FROM po"""))
def n10(spark, sf):
    kind = (F.when(F.col("source") == "x", "ma").when(F.col("source") == "reddit", "insider").when(F.col("source") == "hn", "analyst")
            .when(F.col("source") == "rss", "earnings").otherwise("general"))
    return posts(spark, sf).select("external_id", ent.impact(kind, F.col("text"), F.col("reach") > 300).alias("impact"))


@query("a35_coverage", """
WITH u AS (SELECT conv_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 5)) AS mine FROM conversations WHERE role = 'user'),
k AS (SELECT conv_id, mine, unnest(['elle', 'thtion', 'zzz', 'aufge']) AS kw FROM u),
h AS (SELECT conv_id, mine, kw, len(list_filter(mine, lambda s: contains(s, kw) OR contains(kw, s))) > 0 AS hit FROM k)
SELECT conv_id, count(*) FILTER (hit) AS hits, count(*) AS wanted, round(avg(CAST(hit AS INT)), 6) AS rate FROM h GROUP BY 1""")
def a35(spark, sf):
    u = table(spark, sf, "conversations").where("role = 'user'")
    mine = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 5))
    want = F.array(*[F.lit(w) for w in ("elle", "thtion", "zzz", "aufge")])
    c = u.select("conv_id", ent.coverage(mine, want).alias("c"))
    return c.groupBy("conv_id").agg(F.sum(F.size("c.hits")).alias("hits"), (F.count("*") * 4).alias("wanted"),
                                    F.round(F.sum(F.size("c.hits")) / (F.count("*") * 4), 6).alias("rate"))
