"""Payload to mention transforms, one per public source.

Every function takes a DataFrame with a ``payload`` column (one API answer or feed
per row, as landed) and returns rows of the unified schema. A payload that cannot
be parsed yields no rows and can be counted with ``corrupt_counts``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.times import ts
from .intake import MENTION_COLUMNS

EPOCH = "1970-01-01 00:00:00"


def _seconds(col: Column) -> Column:
    return F.timestamp_seconds(col).cast("timestamp_ntz")


def _iso(col: Column) -> Column:
    return col.try_cast("timestamp").cast("timestamp_ntz")


def _unified(df: DataFrame, source: str, **cols: Column) -> DataFrame:
    base = {
        "source": F.lit(source), "author_handle": F.lit(None).cast("string"), "language": F.lit("und"), "has_media": F.lit(False), **cols,
    }
    out = df.select(*[base[c].alias(c) for c in MENTION_COLUMNS if c != "content_hash"])
    return out.withColumn("content_hash", tx.content_hash(F.col("external_id"), F.col("text"))).select(*MENTION_COLUMNS)


# Schemas of the API answers, reduced to the fields that are used.
REDDIT = ("data struct<children:array<struct<data:struct<id:string,author:string,title:string,selftext:string,created_utc:double,url:string,"
          "permalink:string,preview:string,is_video:boolean,removed_by_category:string,banned_at_utc:double>>>>")
BLUESKY_POST = ("struct<uri:string,author:struct<did:string,handle:string>,record:struct<text:string,createdAt:string,langs:array<string>,embed:string>>")
BLUESKY = f"posts array<{BLUESKY_POST}>, feed array<struct<post:{BLUESKY_POST}>>"
HN = "id bigint, type string, by string, time bigint, title string, url string, text string, score bigint, descendants bigint"
GDELT = "articles array<struct<url:string,title:string,seendate:string,domain:string,language:string>>"
GITHUB = ("items array<struct<id:bigint,full_name:string,description:string,html_url:string,created_at:string,pushed_at:string,updated_at:string,"
          "stargazers_count:bigint,language:string,owner:struct<login:string>>>")
X = "data array<struct<id:string,text:string,author_id:string,created_at:string,lang:string>>"
TEXT_NODE = "struct<_VALUE:string,_type:string>"
ATOM_ENTRY = (f"id:string,title:string,content:{TEXT_NODE},summary:string,published:string,updated:string,"
              "link:array<struct<_href:string,_VALUE:string>>,author:struct<name:string>")
ATOM = f"entry array<struct<{ATOM_ENTRY}>>"
RSS_ITEM = "title:string,description:string,link:string,guid:struct<_VALUE:string,_isPermaLink:string>,pubDate:string,author:string,creator:string,encoded:string"
RSS = f"channel struct<item:array<struct<{RSS_ITEM}>>>"
RDF = f"item array<struct<{RSS_ITEM}>>"


def _json(payloads: DataFrame, schema: str) -> DataFrame:
    return payloads.select(F.from_json("payload", schema, {"mode": "PERMISSIVE"}).alias("j"))


def reddit_listing(payloads: DataFrame) -> DataFrame:
    p = _json(payloads, REDDIT).select(F.explode("j.data.children").alias("c")).select("c.data.*")
    gone = (F.coalesce("author", F.lit("")).isin("", "[deleted]", "[removed]") | F.coalesce(F.col("removed_by_category") != "", F.lit(False))
            | (F.coalesce("banned_at_utc", F.lit(0.0)) > 0))
    title, body = F.coalesce("title", F.lit("")), F.coalesce("selftext", F.lit(""))
    return _unified(
        p.where(~gone), "reddit", external_id=F.col("id"), author_id=F.col("author"), author_handle=F.concat(F.lit("u/"), "author"),
        text=F.when(body != "", F.concat_ws("\n\n", title, body)).otherwise(title), published_at=_seconds(F.col("created_utc")),
        url=F.when(F.coalesce("permalink", F.lit("")) != "", F.concat(F.lit("https://www.reddit.com"), "permalink")).otherwise(F.col("url")),
        has_media=F.col("preview").isNotNull() | F.coalesce("is_video", F.lit(False)))


def reddit_atom(payloads: DataFrame, content_chars: int = 400) -> DataFrame:
    e = payloads.select(F.from_xml("payload", ATOM).alias("x")).select(F.explode("x.entry").alias("e")).select("e.*")
    content = F.substring(tx.collapse(F.regexp_replace(F.coalesce("content._VALUE", F.lit("")), "<[^>]+>", " ")), 1, content_chars)
    title = F.coalesce("title", F.lit(""))
    # Said of the parts and not of the text, which the filter would make a second time; the content is named, as it is used twice.
    rows = e.where((title != "") | (content != "")).select("*", content.alias("body"))
    rows = rows.select("*", F.concat(title, F.when(F.col("body") != "", F.concat(F.lit("\n\n"), "body")).otherwise("")).alias("text"))
    author = F.coalesce("author.name", F.lit("unknown"))
    return _unified(rows, "reddit", external_id=F.col("id"), author_id=author, author_handle=F.concat(F.lit("u/"), author), text=F.col("text"),
                    published_at=_iso(F.col("updated")), url=F.coalesce(F.get("link", F.lit(0))["_href"], F.col("id")))


def bluesky(payloads: DataFrame) -> DataFrame:
    """Search answers (``posts``) and author feeds (``feed[].post``)."""
    posts = F.coalesce("j.posts", F.transform("j.feed", lambda f: f["post"]))
    p = _json(payloads, BLUESKY).select(F.explode(posts).alias("p")).select("p.*")
    p = p.where(F.col("uri").isNotNull() & F.col("author").isNotNull() & F.col("record").isNotNull() & (F.coalesce("record.text", F.lit("")) != ""))
    handle = F.coalesce("author.handle", "author.did")
    return _unified(p, "bluesky", external_id=F.col("uri"), author_id=F.coalesce("author.did", "author.handle"), author_handle=handle, text=F.col("record.text"),
                    language=F.coalesce(F.get("record.langs", F.lit(0)), F.lit("und")), published_at=_iso(F.col("record.createdAt")),
                    url=F.concat(F.lit("https://bsky.app/profile/"), handle, F.lit("/post/"), F.element_at(F.split("uri", "/"), -1)),
                    has_media=F.col("record.embed").isNotNull())


def hn_items(payloads: DataFrame, min_score: int | None = None) -> DataFrame:
    """One item per payload. ``min_score=10`` is the live variant, titles only."""
    i = _json(payloads, HN).select("j.*").where(F.col("id").isNotNull() & (F.coalesce("title", F.lit("")) != ""))
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("id").cast("string"))
    by = F.coalesce("by", F.lit("unknown"))
    link = F.when(F.col("url").isNotNull(), F.concat(F.lit(" — "), "url")).otherwise("")
    body = F.when(F.col("text").isNotNull(), F.concat(F.lit("\n\n"), tx.strip_html(F.col("text")))).otherwise("")
    full = F.concat("title", body, link)
    if min_score is not None:
        i, full = i.where(F.coalesce("score", F.lit(0)) >= min_score), F.col("title")
    return _unified(i, "hn", external_id=F.col("id").cast("string"), author_id=by, author_handle=F.concat(F.lit("user/"), by), text=full,
                    published_at=_seconds(F.coalesce("time", F.lit(0))), url=F.coalesce("url", page), language=F.lit("en" if min_score is not None else "und"))


def feeds(payloads: DataFrame) -> DataFrame:
    """RSS 2.0, Atom and RDF documents in one column, told apart by their root."""
    p = F.col("payload")
    rss = payloads.where(p.rlike("<rss[ >]")).select(F.explode(F.from_xml("payload", RSS)["channel"]["item"]).alias("i"), *_feed_url(payloads))
    rdf = payloads.where(p.rlike("<rdf:RDF[ >]")).select(F.explode(F.from_xml("payload", RDF)["item"]).alias("i"), *_feed_url(payloads))
    atom = payloads.where(p.rlike("<feed[ >]")).select(F.explode(F.from_xml("payload", ATOM)["entry"]).alias("i"), *_feed_url(payloads))
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])
    items = rss.unionByName(rdf).select(
        "feed_url", some(F.col("i.title")).alias("title"), some(F.col("i.description"), F.col("i.encoded")).alias("body"), some(F.col("i.link")).alias("link"),
        some(F.col("i.guid._VALUE")).alias("guid"), some(F.col("i.pubDate")).alias("date"), some(F.col("i.author"), F.col("i.creator")).alias("author"))
    entries = atom.select(
        "feed_url", some(F.col("i.title")).alias("title"), some(F.col("i.content._VALUE"), F.col("i.summary")).alias("body"),
        F.get(F.col("i.link"), F.lit(0))["_href"].alias("link"), some(F.col("i.id")).alias("guid"), some(F.col("i.published"), F.col("i.updated")).alias("date"),
        some(F.col("i.author.name")).alias("author"))
    rows = items.unionByName(entries).where(F.coalesce("guid", "link", "title").isNotNull())
    title = F.coalesce("title", F.lit(""))
    return _unified(
        rows, "rss", external_id=F.coalesce("guid", "link", F.concat_ws("|", "feed_url", "title")), author_id=F.coalesce("author", F.lit("unknown")), author_handle=F.col("author"),
        text=F.when(F.col("body").isNotNull(), F.concat(title, F.lit(" — "), tx.strip_html(F.col("body")))).otherwise(title),
        published_at=tx.parse_date(F.coalesce("date", F.lit(""))), url=F.col("link"))


def _feed_url(payloads: DataFrame) -> list[Column]:
    return [F.col("feed_url") if "feed_url" in payloads.columns else F.lit("").alias("feed_url")]


def gdelt(payloads: DataFrame) -> DataFrame:
    """Article lists. A body that is not JSON has no articles."""
    a = _json(payloads, GDELT).select(F.explode("j.articles").alias("a")).select("a.*")
    seen, title, domain = F.coalesce("seendate", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("domain", F.lit("unknown"))
    return _unified(a, "gdelt", external_id=F.coalesce("url", "title"), author_id=domain, author_handle=domain,
                    text=F.when(seen != "", F.concat(title, F.lit(" — "), seen)).otherwise(title), language=F.coalesce("language", F.lit("und")),
                    published_at=tx.parse_date(seen), url=F.col("url"))


def github(payloads: DataFrame, now: datetime | None = None, max_age_days: float = 30, min_stars: int = 500, max_idle_days: float = 2) -> DataFrame:
    """Repositories. With ``now`` only young, popular and active ones are kept."""
    r = _json(payloads, GITHUB).select(F.explode("j.items").alias("r")).select("r.*").where(F.coalesce("full_name", F.lit("")) != "")
    at = _iso(F.col("updated_at"))
    if now is not None:
        r = r.where((_iso(F.col("created_at")) >= ts(now, -max_age_days * 86400)) & (F.coalesce("stargazers_count", F.lit(0)) >= min_stars)
                    & (_iso(F.col("pushed_at")) >= ts(now, -max_idle_days * 86400)))
        at = _iso(F.col("pushed_at"))
    owner = F.coalesce("owner.login", F.lit("unknown"))
    return _unified(r, "github", external_id=F.coalesce(F.col("id").cast("string"), "full_name"), author_id=owner, author_handle=owner,
                    text=F.concat_ws(": ", "full_name", F.coalesce("description", F.lit(""))), language=F.coalesce("language", F.lit("und")), published_at=at,
                    url=F.coalesce("html_url", F.concat(F.lit("https://github.com/"), "full_name")))


def x_search(payloads: DataFrame) -> DataFrame:
    t = _json(payloads, X).select(F.explode("j.data").alias("t")).select("t.*").where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))
    return _unified(t, "x", external_id=F.col("id"), author_id=F.coalesce("author_id", F.lit("unknown")), text=F.col("text"), language=F.coalesce("lang", F.lit("und")),
                    published_at=_iso(F.col("created_at")), url=F.concat(F.lit("https://x.com/i/web/status/"), "id"))


def html_blocks(html: Column, block: str, min_chars: int = 20) -> Column:
    """Texts of all blocks matching ``block`` (group 1) longer than ``min_chars``."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(block), F.lit(1)), tx.strip_html), lambda t: F.length(t) > min_chars)


def x_profile_html(pages: DataFrame, now: datetime, per_page: int = 8) -> DataFrame:
    """Posts of a profile page: text blocks zipped with status links, eight per page."""
    texts = html_blocks(F.col("html"), r'(?s)<div class="tweet-content[^"]*"[^>]*>(.*?)</div>')
    link = r'href="/([^/"\']+)/status/([0-9]+)"'
    users, ids = (F.regexp_extract_all("html", F.lit(link), F.lit(i)) for i in (1, 2))
    n = F.least(F.size("t"), F.size("u"), F.lit(per_page))
    z = pages.select(texts.alias("t"), users.alias("u"), ids.alias("i")).select(
        F.explode(F.slice(F.arrays_zip("t", "u", "i"), 1, n)).alias("p")).select("p.t", "p.u", "p.i")
    return _unified(z, "x", external_id=F.col("i"), author_id=F.col("u"), author_handle=F.concat(F.lit("@"), "u"), text=F.col("t"), published_at=ts(now),
                    url=F.concat(F.lit("https://x.com/"), "u", F.lit("/status/"), "i"))


def corrupt_counts(payloads: DataFrame, schema: str) -> DataFrame:
    """Payloads and unparsable payloads per source, so one bad source shows."""
    ok = F.try_parse_json("payload").isNotNull()
    return payloads.groupBy("source").agg(F.count("*").alias("payloads"), F.count_if(~ok).alias("corrupt"))
