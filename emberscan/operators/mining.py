"""Entities, handles and keywords at table level."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions import entities as ent
from ..functions.times import within
from ..session import cut


def explode_entities(posts: DataFrame, only: str | None = None) -> DataFrame:
    return posts.select("trend_id", "external_id", "published_at", F.posexplode(ent.entity_array(F.col("text"), only)).alias("pos", "e")).select(
        "trend_id", "external_id", "published_at", "pos", F.col("e.type").alias("type"), F.col("e.value").alias("value"))


#: Posts of a trend that are looked at first; a trend that names too few entities in them is looked at whole.
HEAD = 64


def _first_seen(posts: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` distinct entities of a trend, each with its first sight."""
    first = explode_entities(posts).groupBy("trend_id", "type", F.lower("value").alias("key")).agg(
        F.min(F.struct("published_at", "external_id", "pos", "value")).alias("first"))
    w = Window.partitionBy("trend_id").orderBy("first.published_at", "first.external_id", "first.pos")
    return first.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= limit)


def cluster_entities(posts: DataFrame, limit: int = 20) -> DataFrame:
    """First ``limit`` distinct entities of a trend, in order of first sight.

    A trend that has them all in its first ``HEAD`` posts needs no post behind
    the one that brings the last: those are left out before any text is looked
    at. Any other trend keeps all its posts. Repeats are reduced to one row per
    (trend, type, value) before anything is ranked, and the rankings keep
    ``limit`` or ``HEAD`` rows per task before their shuffle.
    """
    at = ["trend_id", "published_at", "external_id"]
    place = F.row_number().over(Window.partitionBy("trend_id").orderBy("published_at", "external_id"))
    head = posts.select(*at).withColumn("place", place).where(F.col("place") <= HEAD).groupBy("trend_id").agg(
        F.max(F.struct("published_at", "external_id")).alias("upto"))
    early = _until(posts, head)
    full = _first_seen(early, limit).where(F.col("ord") == limit).select("trend_id", F.struct("first.published_at", "first.external_id").alias("upto"))
    top = _first_seen(_until(posts, cut(full)), limit)
    return top.select("trend_id", "ord", "type", F.col("first.value").alias("value"))


def _until(posts: DataFrame, ends: DataFrame) -> DataFrame:
    """Posts up to the position ``upto`` of their trend, all posts of trends without one."""
    held = posts.join(ends.withColumnRenamed("trend_id", "of"), posts["trend_id"].eqNullSafe(F.col("of")), "left")
    return held.where(F.col("upto").isNull() | (F.struct("published_at", "external_id") <= F.col("upto"))).drop("of", "upto")


def entity_lists(posts: DataFrame, limit: int = 20) -> DataFrame:
    """``cluster_entities`` as one ARRAY per trend (at most ``limit`` items)."""
    item = F.struct("ord", "type", "value")
    return cluster_entities(posts, limit).groupBy("trend_id").agg(F.array_sort(F.collect_list(item)).alias("x")).select(
        "trend_id", F.transform("x", lambda s: F.struct(s["type"].alias("type"), s["value"].alias("value"))).alias("entities"))


def harvest_handles(posts: DataFrame, now: datetime, ttl_seconds: float = 7200.0, pool: int = 30) -> DataFrame:
    """Handles named in other networks' posts, most recent ``pool`` within the TTL."""
    src = posts.where(F.col("source").isin("reddit", "bluesky", "hn"))
    h = src.select("published_at", F.explode(ent.handles(F.col("text"))).alias("handle"))
    key = F.lower("handle")
    kept = h.where(~key.isin(params.BLOCKED_HANDLES)).groupBy(key.alias("handle")).agg(
        F.count("*").alias("mentions"), F.max("published_at").alias("last_seen"))
    return kept.where(within(F.col("last_seen"), now, ttl_seconds)).orderBy(F.desc("last_seen"), "handle").limit(pool)


def top_handles(harvested: DataFrame, k: int = 3) -> DataFrame:
    """The most mentioned of the harvested handles."""
    return harvested.orderBy(F.desc("mentions"), "handle").limit(k)


def active_keywords(top_trends: DataFrame) -> DataFrame:
    """Title words and first entities of the given trends, one row per keyword."""
    words = F.concat(ent.title_words(F.col("title")), F.transform(F.slice("entities", 1, 3), lambda e: e["value"]))
    return top_trends.select(F.explode(words).alias("keyword")).distinct()


def top_entities(posts: DataFrame, kind: str, limit: int = 10) -> DataFrame:
    e = explode_entities(posts, kind)
    return e.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)
