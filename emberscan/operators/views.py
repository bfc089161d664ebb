"""List views over scored trends: filters, rankings, pages, projections."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions import text as tx
from ..functions.numeric import clamp, fixed1, js_round
from ..functions.times import micros, ts, within
from .profile import lookup


def trending(scored: DataFrame, now: datetime, limit: int = 20) -> DataFrame:
    """Active within 24 h and not dead, best score first."""
    return (scored.where(within(F.col("last_seen"), now, 86400) & (F.col("score") > 0))
            .orderBy(F.desc("score"), "trend_id").limit(limit))


def all_recent(scored: DataFrame, now: datetime, limit: int = 50) -> DataFrame:
    """Active within 24 h, most recently seen first."""
    return (scored.where(within(F.col("last_seen"), now, 86400))
            .orderBy(F.desc("last_seen"), "trend_id").limit(limit))


def list_trends(
    trends: DataFrame, source: str | None = None, phase: str | None = None, min_score: float | None = None,
    q: str | None = None, tone: str | None = None, shape: str | None = None, direction: str | None = None,
    seen_after: Column | None = None, limit: int = 30,
) -> DataFrame:
    """Filtered list, best score first. Filters come before the limit.

    ``source`` matches any source of the trend, ``q`` is a plain substring.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    conds = []
    if source:
        conds.append(F.array_contains("sources", source))
    if phase:
        conds.append(F.col("phase") == phase)
    if min_score is not None:
        conds.append(F.col("score") >= min_score)
    if q:
        needle = F.lit(q.lower())
        conds.append(F.contains(F.lower("title"), needle) | F.contains(F.lower("summary"), needle))
    for name, value in (("tone", tone), ("shape", shape), ("dir", direction)):
        if value:
            conds.append(F.col(name) == value)
    if seen_after is not None:
        conds.append(F.col("last_seen") > seen_after)
    for c in conds:
        trends = trends.where(c)
    return trends.orderBy(F.desc("score"), "trend_id").limit(limit)


def trend_view(trends: DataFrame, now: datetime) -> DataFrame:
    """Display row of a trend: momentum, heat, status, evidence, tags, age."""
    v, ph, s = F.col("velocity"), F.col("phase"), F.coalesce("score", F.lit(0.0))
    delta = (F.when(ph == "rising", js_round(v * 10)).when(ph == "decaying", -js_round(v * 5))
             .when(ph == "peaked", js_round(v * 2)).otherwise(F.lit(0)).cast("bigint"))
    heat = F.when(s >= 70, "Muy caliente").when(s >= 50, "Caliente").when(s >= 30, "Templado").otherwise("Enfriándose")
    label = (F.when(ph == "forming", "Señal emergente").when(ph == "rising", "Crecimiento acelerado")
             .when(ph == "peaked", "En pico").otherwise("En desaceleración"))
    tech = technical_label(F.col("sources"))
    minutes = F.greatest(F.lit(1), js_round((F.lit(int((now - datetime(1970, 1, 1)) / timedelta(microseconds=1))) - micros(F.col("first_seen"))) / 6e7))
    age = F.when(minutes < 60, F.format_string("%dmin", minutes)).otherwise(F.format_string("%dh", js_round(minutes / 60.0)))
    rows = trends.withColumn("delta", delta)
    return rows.select(
        "trend_id", "title", F.col("primary_source").alias("source"), lookup(F.col("primary_source"), params.TONE_BY_SOURCE, "muted").alias("tone"),
        F.when(tech == "", label).otherwise(F.concat_ws(" · ", tech, label)).alias("status"),
        F.when(F.col("delta") > 5, "up").when(F.col("delta") < -5, "down").otherwise("flat").alias("dir"),
        F.date_format("last_seen", "HH:mm").alias("time"), heat.alias("heat"), js_round(s).alias("confidence"), "mentions", "delta", "shape",
        F.concat(F.substring("summary", 1, 180), F.when(F.length("summary") > 180, "…").otherwise("")).alias("why"),
        F.array(
            F.struct(F.lit("Velocidad").alias("label"), F.format_string("%d/h", js_round(v * 60)).alias("value")),
            F.struct(F.lit("Fuentes").alias("label"), F.size("sources").cast("string").alias("value")),
            F.struct(F.lit("Edad").alias("label"), age.alias("value"))).alias("evidence"),
        "phase", "velocity", "score", "unique_authors", "first_seen", "last_seen", "sources", "source_counts", "penalty", "is_trending")


def technical_label(sources: Column) -> Column:
    """Label of trends seen only in technical sources, else an empty string."""
    only_git = (F.size(sources) == 1) & (F.get(sources, F.lit(0)) == "github")
    only_tech = F.forall(sources, lambda s: s.isin(params.TECHNICAL))
    return F.when(only_git, "Tendencia técnica · Desarrollo").when(only_tech, "Tendencia técnica").otherwise("")


def reliability(confidence: Column) -> Column:
    return F.when(confidence > 70, "Alta").when(confidence >= 40, "Media").otherwise("Baja")


def saved_list(saved: DataFrame, trends: DataFrame, folder: str = "all", q: str | None = None, sort: str = "recent") -> DataFrame:
    """Saved trends of a folder (``pinned``, ``none``, a name, ``all``) with text search."""
    s = saved.join(trends, "trend_id")
    if folder == "pinned":
        s = s.where("pinned")
    elif folder == "none":
        s = s.where(F.coalesce("folder", F.lit("")) == "")
    elif folder != "all":
        s = s.where(F.col("folder") == folder)
    if q:
        needle = F.lit(q.lower())
        s = s.where(F.contains(F.lower("title"), needle) | F.contains(F.lower("status"), needle)
                    | F.coalesce(F.contains(F.lower("notes"), needle), F.lit(False)))
    order = {"recent": "created_at", "mentions": "mentions", "delta": "delta", "confidence": "confidence"}[sort]
    return s.orderBy(F.desc(order), "trend_id")


def engine_log(log: DataFrame, level: str | None = None, limit: int = 200) -> DataFrame:
    if level:
        log = log.where(F.col("level") == level)
    return log.orderBy(F.desc("logged_at"), F.desc("id")).limit(min(limit, 200))


def briefing(trends: DataFrame, latest: DataFrame) -> DataFrame:
    """Extractive briefing: narrative, key points, risk flags, confidence, evidence.

    ``latest``: up to five newest mentions per trend with their ``rank``.
    """
    top = latest.where("rank <= 5").groupBy("trend_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "mention_id"))), lambda s: s["mention_id"]).alias("evidence_ids"),
        F.max(F.when(F.col("rank") == 1, F.struct("source", F.substring(tx.sanitise(F.col("text")), 1, 200).alias("quote")))).alias("head"))
    j = trends.join(top, "trend_id", "left")
    srcs, sources = F.array_join("sources", ", "), F.col("sources")
    only_git = (F.size(sources) == 1) & (F.get(sources, F.lit(0)) == "github")
    tech = F.forall(sources, lambda s: s.isin(params.TECHNICAL))
    hourly = js_round(F.col("velocity") * 60)
    what = (F.when(only_git, F.concat(F.lit("Actividad de desarrollo detectada en GitHub: "), F.col("title"), F.lit(".")))
            .when(tech, F.concat(F.lit("Señal técnica emergiendo en "), srcs, F.lit(": "), F.col("title"), F.lit(".")))
            .otherwise(F.concat(F.lit("Narrativa ganando tracción en "), srcs, F.lit(": "), F.col("title"), F.lit("."))))
    matters = F.format_string("%d menciones/hora en ventana de 15min. %d menciones totales de %d autores. Fase: %s.",
                              hourly, F.col("mentions"), F.col("unique_authors"), F.col("phase"))
    quote = F.when(F.coalesce("head.quote", F.lit("")) != "", F.concat(F.lit("Fuente reciente ("), F.col("head.source"), F.lit('): "'), F.col("head.quote"), F.lit('"'))).otherwise(
        "Sin menciones recientes para citar.")
    p = F.col("penalty")
    return j.select(
        "trend_id", F.concat_ws(" ", what, matters, quote).alias("narrative"),
        F.array(
            F.format_string("%d menc/hora (15min)", hourly), F.format_string("%d menciones · %d autores", F.col("mentions"), F.col("unique_authors")),
            F.concat(F.lit("Fuentes: "), srcs), F.concat(F.lit("Score: "), fixed1(F.col("score")), F.lit("/100")),
            F.when(tech, "Tendencia técnica (sin respaldo social aún)").otherwise("Respaldado por redes sociales")).alias("key_points"),
        F.array_compact(F.array(
            F.when(p > 0.4, "Spam/bot detectado"), F.when((p >= 0.3) & (p < 0.4), "Posible bot"),
            F.when(only_git, "Solo GitHub — no es viralidad social"), F.when(F.col("velocity") > 5, "Velocidad anómala"),
            F.when(F.col("phase") == "decaying", "En desaceleración"),
            F.when(tech & (F.size(sources) == 1), "Fuente única — baja corroboración"))).alias("risk_flags"),
        clamp(F.col("score") / 100, 0.2, 0.95).alias("confidence"), "evidence_ids")


def latest_mentions(mentions: DataFrame, n: int = 5) -> DataFrame:
    """Newest ``n`` mentions per trend; each task keeps ``n`` before the shuffle."""
    w = Window.partitionBy("trend_id").orderBy(F.desc("published_at"), F.desc("external_id"))
    return mentions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def ranked(trends: DataFrame, by: str, limit: int) -> DataFrame:
    """Top list with its position; the window runs over the ``limit`` kept rows."""
    top = trends.orderBy(F.desc(by), "trend_id").limit(limit)
    return top.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(by), "trend_id")))


def page(trends: DataFrame, limit: int, cursor: tuple[float, str] | None = None) -> DataFrame:
    """Keyset page by (score desc, id): ``limit`` rows and a has_more flag."""
    if cursor is not None:
        score, last = cursor
        trends = trends.where((F.col("score") < score) | ((F.col("score") == score) & (F.col("trend_id") > last)))
    probe = trends.orderBy(F.desc("score"), "trend_id").limit(limit + 1)
    w = Window.partitionBy(F.lit(1))
    pos = F.row_number().over(w.orderBy(F.desc("score"), "trend_id"))
    return probe.select("*", pos.alias("position"), (F.count("*").over(w) > limit).alias("has_more")).where(F.col("position") <= limit)


def phase_changes(history: DataFrame, key: str = "trend_id", t: str = "bucket_time") -> DataFrame:
    """Rows of a per-bucket phase history where the phase differs from the one before."""
    w = Window.partitionBy(key).orderBy(t)
    h = history.select(key, t, "phase", "velocity", F.lag("phase").over(w).alias("from_phase"), F.lag("velocity").over(w).alias("_v"))
    return h.where(F.col("from_phase") != F.col("phase")).select(
        key, t, "from_phase", F.col("phase").alias("to_phase"), (F.col("velocity") - F.col("_v")).alias("velocity_change"))


def revived(peeks: DataFrame, history: DataFrame, limit: int = 3) -> DataFrame:
    """Peeked, not acted on, and in another phase now than at the peek."""
    h = history.select("trend_id", "bucket_time", "phase")
    at_peek = peeks.where("not acted").join(h, "trend_id").where(F.col("bucket_time") <= F.col("peeked_at")).groupBy("trend_id", "peeked_at").agg(
        F.max_by("phase", "bucket_time").alias("phase_then"))
    cur = h.groupBy("trend_id").agg(F.max_by("phase", "bucket_time").alias("phase_now"))
    return at_peek.join(cur, "trend_id").where("phase_then <> phase_now").orderBy(F.desc("peeked_at"), "trend_id").limit(limit)


def snoozed(saved: DataFrame, now: datetime) -> DataFrame:
    """Hidden until the snooze ends; ``woke_up`` on those that just came back."""
    u = F.col("snoozed_until")
    return saved.withColumns({"hidden": F.coalesce(u > ts(now), F.lit(False)), "woke_up": F.coalesce(u <= ts(now), F.lit(False))})


# Role presets: which trends a reader of a kind is shown.
ROLES = ("journalist", "trader", "brand", "osint", "political")


def role_preset(trends: DataFrame, role: str) -> DataFrame:
    legit, trash, origin = F.col("legitimacy"), F.col("trash"), F.col("origin_quality")
    conds = {
        "journalist": (F.col("phase") == "forming") & legit.isin("PRE_BURST", "LEGIT") & (origin > 0.6) & (trash < 0.3),
        "trader": (F.col("has_gdelt") | F.col("has_reddit")) & (trash < 0.4) & (F.col("delta_v") > 3 * F.col("baseline")) & (legit == "LEGIT"),
        "brand": (trash < 0.4) & (origin > 0.4),
        "osint": F.col("has_gdelt") & (F.col("has_x") | F.col("has_reddit")) & (trash < 0.3) & (F.col("authenticity") > 0.7),
        "political": (trash > 0.5),
    }
    return trends.where(conds[role])
