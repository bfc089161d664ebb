"""Clusters: assignment, roll-up and life cycle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions import entities as ent
from ..functions import text as tx
from ..functions.times import age_hours, ts, within
from ..session import cut
from . import dedup, graph, vectors


def three_stage_gate(jaccard_min: float = params.JACCARD_MIN, cosine_min: float = params.COSINE_LIVE, veto: str = "asymmetric"):
    """Signature Jaccard, then embedding cosine, then the rigid entity veto."""

    def gate(pairs: DataFrame) -> DataFrame:
        j = dedup.signature_jaccard(F.col("a_sig"), F.col("b_sig"))
        near = pairs.withColumn("j", j).where(F.col("j") >= jaccard_min)
        near = near.withColumn("c", vectors.cosine(F.col("a_emb"), F.col("b_emb"))).where(F.col("c") >= cosine_min)
        clash = ent.rigid_veto(F.col("b_ents"), F.col("a_ents"), veto)
        return near.where(~clash).select("leader", "leader_ord", "id", (0.5 * F.col("j") + 0.5 * F.col("c")).alias("score"))

    return gate


def signatures(docs: DataFrame) -> DataFrame:
    """Signatures of (id, text): what buckets are made of."""
    return dedup.minhash(docs, "id", tx.tokens(F.col("text"))).select("id", "sig")


def compared(docs: DataFrame):
    """Embedding and entities of those of (id, text) that are asked for: the dear features, which only items that meet another need."""

    def of(ids: DataFrame) -> DataFrame:
        few = docs.join(ids, "id", "left_semi").repartition("id")
        return few.select("id", vectors.embed_text(F.col("text"), "padded").alias("emb"), ent.entity_array(F.col("text")).alias("ents"))

    return of


def features(docs: DataFrame) -> DataFrame:
    """Signature, embedding and entities of (id, text)."""
    return compared(docs)(docs.select("id")).join(signatures(docs), "id")


def leader_clusters(docs: DataFrame, **gate) -> DataFrame:
    """Leader clusters of (id, text) in id order: (id, leader).

    Equal texts are folded before anything is compared. A copy of a leader stays
    with it; a copy of a member takes the best leader known at its own turn.
    """
    keyed = docs.select("id", "text", F.md5("text").alias("key"))
    first = keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last_ord"))
    fold = cut(keyed.select("id", "key").join(first, "key").select("id", "first", "last_ord"))
    uniq = docs.join(fold.where("id = first").select("id"), "id")
    items = cut(signatures(uniq).join(fold.where("id = first").select("id", F.col("id").alias("ord"), "last_ord"), "id"))
    chosen, matches = graph.leaders(items, dedup.lossless_bands(items, "id"), three_stage_gate(**gate), more=compared(uniq))
    known = chosen.select(F.col("id").alias("first"), F.col("id").alias("leader"))
    own = fold.join(known, "first").select("id", "leader")
    followers = fold.join(known, "first", "left_anti")
    m = matches.select(F.col("id").alias("first"), "leader", "leader_ord", "score")
    best = followers.join(m, "first").where("leader_ord < id").groupBy("id").agg(
        F.max_by("leader", F.struct("score", -F.col("leader_ord"))).alias("leader"))
    return own.unionByName(best)


def rollup(posts: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Cluster row from its posts: title, summary, sources, languages, span, counts.

    Title: shortest non-empty text of the three latest posts, at most 140 long.
    Summary: first 200 characters of the longest post. Nothing is collected per
    post: minima, maxima and per-(cluster, source) counts only.
    """
    last3 = F.row_number().over(Window.partitionBy("trend_id").orderBy(F.desc("published_at"), F.desc("external_id")))
    t = F.trim("text")
    recent = posts.select("trend_id", "published_at", "external_id", t.alias("t"), last3.alias("rn")).where("rn <= 3")
    title = recent.where(F.length("t") > 0).groupBy("trend_id").agg(F.min(F.struct(F.length("t"), "rn", "t")).alias("x")).select(
        "trend_id", F.when(F.length("x.t") > 140, F.concat(F.substring("x.t", 1, 137), F.lit("..."))).otherwise(F.col("x.t")).alias("title"))
    pos = F.struct("published_at", "external_id")
    per = posts.groupBy("trend_id", "source").agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    mix = per.groupBy("trend_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda s: s["source"]).alias("sources"),
        F.max_by("source", F.struct("n", -F.unix_micros(F.col("first.published_at").cast("timestamp")), -F.col("first.external_id"))).alias("primary_source"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("source_counts"))
    lang = posts.groupBy("trend_id", F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n")).groupBy("trend_id").agg(
        F.array_sort(F.collect_list("lang")).alias("languages"))
    length = F.length("text")
    core = posts.groupBy("trend_id").agg(
        F.count("*").alias("mentions"), F.count_distinct("author_id").alias("unique_authors"),
        F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"))
    longest = posts.groupBy("trend_id").agg(
        F.min(F.struct((-length).alias("l"), F.col("published_at"), F.col("external_id"), F.substring("text", 1, 200).alias("summary"))).alias("x"),
        F.min(F.struct("published_at", "external_id", "source", "author_id", "url")).alias("o")).select(
        "trend_id", F.col("x.summary").alias("summary"),
        F.struct("o.source", F.col("o.author_id").alias("author"), "o.url", F.lit(0).alias("lag_seconds")).alias("originator"))
    return core.join(longest, "trend_id").join(title, "trend_id", "left").join(mix, "trend_id").join(lang, "trend_id")


def merge_pairs(checks: DataFrame, min_cosine: float = 0.85) -> DataFrame:
    """Pairs of clusters close in two consecutive checks; the older id survives.

    ``checks``: (check_no, id, born, centroid). All checks are searched at once,
    pairs forming inside a check only; a pair of one check is then joined with
    the same pair of the check before.
    """
    c = checks.select("check_no", "id", F.col("centroid").alias("vec"))
    n = vectors.nearest(c, c, None, min_cosine, earlier_only=True, within="check_no", keep_within=True)
    close = cut(n.select(F.col("within").cast(checks.schema["check_no"].dataType).alias("check_no"), F.col("neighbour").alias("a"), F.col("id").alias("b")))
    before = close.select((F.col("check_no") + 1).cast(checks.schema["check_no"].dataType).alias("check_no"), "a", "b")
    run = close.join(before, ["check_no", "a", "b"], "left_semi")
    born = checks.groupBy("id").agg(F.min("born").alias("born"))
    run = run.groupBy("a", "b").agg(F.min("check_no").alias("check_no"))
    run = run.join(born.select(F.col("id").alias("a"), F.col("born").alias("ab")), "a").join(
        born.select(F.col("id").alias("b"), F.col("born").alias("bb")), "b")
    return run.select("a", "b", "check_no", F.when(F.struct("ab", "a") <= F.struct("bb", "b"), F.col("a")).otherwise(F.col("b")).alias("survivor"))


def life_cycle(mentions: DataFrame, key: str = "trend_id", archive_hours: int = 24, renew_hours: int = 168) -> DataFrame:
    """Runs of a cluster: archived after 24 h idle, reopened within 7 d, else a new id.

    The gaps are found on hourly rows (``gap_starts``), so a busy cluster brings
    at most one row per hour to the window.
    """
    c = dedup.gap_starts(mentions, [key], "published_at", "external_id", archive_hours * 3600, 3600)
    w = Window.partitionBy(key).orderBy("chunk")
    prev = F.lag("last_us").over(w)
    gap_h = (F.col("us") - prev) / F.lit(3.6e9)
    kind = F.when(prev.isNull(), "new").when(gap_h > renew_hours, "renewed").when(gap_h > archive_hours, "reopened").otherwise("active")
    runs = c.withColumn("kind", kind).withColumn(
        "version", F.sum(F.col("kind").isin("new", "renewed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "version").agg(
        F.min("us").alias("start_us"), F.max("last_us").alias("end_us"), F.sum("n").alias("mentions"),
        F.count_if(F.col("kind") == "reopened").alias("reopened"))


def garbage(clusters: DataFrame, now: datetime, idle_seconds: float = 6 * 3600, min_mentions: int = 3) -> DataFrame:
    """Clusters to drop: quiet for six hours and fewer than three mentions."""
    return clusters.where((F.col("last_seen") < ts(now, -idle_seconds)) & (F.col("mentions") < min_mentions))


def refresh_due(current: DataFrame, titled: DataFrame, max_new: int = 20, max_drift: float = 0.4) -> DataFrame:
    """Clusters whose title is stale: new, grown by more than 20, or drifted."""
    t = titled.select("id", F.col("mentions").alias("titled_mentions"), F.col("centroid").alias("titled_centroid"))
    j = current.join(t, "id", "left")
    drift = 1 - vectors.cosine(F.col("centroid"), F.col("titled_centroid"))
    return j.select(
        "id", F.col("titled_mentions").isNull().alias("is_new"),
        (F.col("mentions") - F.coalesce("titled_mentions", F.lit(0))).alias("new_mentions"), drift.alias("drift")).withColumn(
        "due", F.col("is_new") | (F.col("new_mentions") > max_new) | F.coalesce(F.col("drift") > max_drift, F.lit(False)))


def title_sources(mentions: DataFrame, now: datetime, k: int = 5) -> DataFrame:
    """The ``k`` mentions of best author quality times recency per cluster."""
    weight = F.coalesce("author_quality", F.lit(0.5)) * F.exp(-age_hours(F.col("published_at"), now) / 6.0)
    w = Window.partitionBy("trend_id").orderBy(F.desc("weight"), "external_id")
    return mentions.select("trend_id", "external_id", weight.alias("weight")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
