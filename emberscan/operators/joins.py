"""Joins between trends, rules, follows, scores and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_saved(trends: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved entries with their trend, pinned first, newest first."""
    return saved.join(trends, "trend_id", "left").orderBy(F.desc("pinned"), F.desc("created_at"), "trend_id")


def rules_for_trends(rules: DataFrame, trends: DataFrame, block: int = 1000) -> DataFrame:
    """Each rule with the trends it watches; a rule without a trend watches all.

    Own rules are an equi-join. Global rules are dealt into blocks of about
    ``block`` and trends meet them block by block, an equi-join too, so neither
    side has to fit in a task whatever their numbers. Which rules can fire at all
    is the business of ``alerts.hits``, which does not form these pairs.
    """
    rules = rules.withColumnRenamed("phase", "rule_phase")
    own = rules.where("trend_id is not null").join(trends, "trend_id")
    every = rules.where("trend_id is null").drop("trend_id")
    blocks = every.count() // block + 1
    dealt = every.withColumn("_block", F.pmod(F.xxhash64("rule_id"), F.lit(blocks)))
    spread = trends.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return own.unionByName(spread.join(dealt, "_block").select(own.columns))


def mark_followed(trends: DataFrame, follows: DataFrame) -> DataFrame:
    mine = follows.select("trend_id").distinct().withColumn("_f", F.lit(True))
    return trends.join(mine, "trend_id", "left").withColumn("followed", F.col("_f").isNotNull()).drop("_f")


def latest_score(scores: DataFrame, asof=None) -> DataFrame:
    """Latest bucket per trend, optionally at or before ``asof``: one aggregation."""
    if asof is not None:
        scores = scores.where(F.col("bucket_time") <= asof)
    cols = [c for c in scores.columns if c not in ("trend_id", "bucket_time")]
    return scores.groupBy("trend_id").agg(F.max(F.struct("bucket_time", *cols)).alias("x")).select(
        "trend_id", F.col("x.bucket_time").alias("bucket_time"), *[F.col(f"x.{c}").alias(c) for c in cols])


def expand_references(edges: DataFrame, seeds: DataFrame, per_seed: int) -> DataFrame:
    """Papers cited by the seeds, at most ``per_seed`` each, without the seeds.

    ``edges``: (src, dst, ord). The seed list of a paper is at most the number of
    seeds, which a reader picks by hand.
    """
    s = seeds.select(F.col("id").alias("src")).distinct()
    uniq = edges.join(s, "src").groupBy("src", "dst").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("src").orderBy("ord", "dst")
    top = uniq.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_seed)
    out = top.join(s.select(F.col("src").alias("dst")), "dst", "left_anti")
    return out.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("source_ids"))


def pickup(mentions: DataFrame, first: str, then: str, within_seconds: int = 3600, slot_seconds: int = 60) -> DataFrame:
    """Posts of ``first`` answered by a post of ``then`` on the same trend in time.

    One row per post of ``first`` with the lag to the earliest answer. The next
    answer is in the post's own time slot (a window over one slot) or is the
    first answer of the next slot that has one (a window over slot rows, whose
    number is set by the clock). No pair of posts is formed, so a trend with very
    many posts costs a sort per slot and nothing more.
    """
    us = F.unix_micros(F.col("published_at").cast("timestamp"))
    rows = mentions.where(F.col("source").isin(first, then)).select(
        "trend_id", "external_id", us.alias("us"), (F.col("source") == then).alias("answer"),
        F.floor(us / F.lit(slot_seconds * 1_000_000)).alias("slot"))
    at = F.when(F.col("answer"), F.col("us"))
    ahead = Window.partitionBy("trend_id", "slot").orderBy("us").rangeBetween(0, Window.unboundedFollowing)
    own = rows.withColumn("own", F.min(at).over(ahead)).where(~F.col("answer"))
    slots = rows.groupBy("trend_id", "slot").agg(F.min(at).alias("first"))
    later = Window.partitionBy("trend_id").orderBy("slot").rowsBetween(1, Window.unboundedFollowing)
    nxt = slots.select("trend_id", "slot", F.min("first").over(later).alias("later"))
    lag = F.coalesce("own", "later") - F.col("us")
    return own.join(nxt, ["trend_id", "slot"]).select("trend_id", "external_id", lag.alias("lag_us")).where(
        F.col("lag_us") <= within_seconds * 1_000_000)


def orphan_rules(rules: DataFrame, trends: DataFrame) -> DataFrame:
    """Rules that name a trend which does not exist."""
    return rules.where("trend_id is not null").join(trends.select("trend_id"), "trend_id", "left_anti")


def enrich(base: DataFrame, detail: DataFrame, text_limit: int = 500) -> DataFrame:
    """Base rows with details: first per id, fields fall back, id and title required."""
    first = base.where(F.coalesce("id", F.lit("")) != "").groupBy("id").agg(F.min(F.struct("ord", "title", "year", "venue")).alias("b"))
    d = detail.groupBy("id").agg(F.min(F.struct("title", "year", "venue", "abstract")).alias("d"))
    pick = lambda a, b: F.coalesce(F.nullif(a.cast("string"), F.lit("")), F.nullif(b.cast("string"), F.lit("")))
    j = first.join(d, "id", "left")
    out = j.select("id", F.trim(pick(F.col("b.title"), F.col("d.title"))).alias("title"), pick(F.col("d.year"), F.col("b.year")).alias("year"),
                   pick(F.col("d.venue"), F.col("b.venue")).alias("venue"), F.substring(F.trim(F.col("d.abstract")), 1, text_limit).alias("abstract"))
    return out.where(F.coalesce("title", F.lit("")) != "")


def reconcile(old: DataFrame, new: DataFrame, key: str, cap: int = 50, by: str = "confidence") -> DataFrame:
    """New snapshot upserted over the old one: status per id, best ``cap`` kept."""
    top = new.orderBy(F.desc(by), key).limit(cap)
    o = old.select(key, F.lit(True).alias("_old"))
    n = top.withColumn("_new", F.lit(True))
    j = o.join(n, key, "full_outer")
    status = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").otherwise("updated")
    return j.withColumn("status", status).drop("_old", "_new")


def membership(trends: DataFrame, saved: DataFrame, armed: DataFrame, hidden: DataFrame) -> DataFrame:
    """Visible trends (hidden ones excluded) flagged as saved or watched."""
    flag = lambda ids, name: ids.select("trend_id").distinct().withColumn(name, F.lit(True))
    v = trends.join(hidden.select("trend_id"), "trend_id", "left_anti")
    v = v.join(flag(saved, "is_saved"), "trend_id", "left").join(flag(armed, "is_watched"), "trend_id", "left")
    return v.fillna({"is_saved": False, "is_watched": False})
