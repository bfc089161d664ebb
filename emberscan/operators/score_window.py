"""Score of a trend over one window: velocity, delta, confidence, shape, heat, evidence."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.numeric import clamp01, entropy, js_round, xlog2x
from ..functions.times import age_hours, ts, within
from .profile import origin_quality_first5
from .series import bucket_index, delta_pct, ewma_series, in_window, variance_pop

# Display labels.
HEAT_HOT, HEAT_WARM, HEAT_MILD, HEAT_COOL = "Muy caliente", "Caliente", "Templado", "Enfriándose"
WEEKDAYS = ["Dom", "Lun", "Mar", "Mié", "Jue", "Vie", "Sáb"]


def window_facts(mentions: DataFrame, now: datetime, window: params.ScoreWindow) -> DataFrame:
    """Counts, buckets, sentiment, baseline and evidence windows in one pass.

    Everything here is a plain sum, minimum or maximum with map-side combine. The
    rows read are those of the window or of the seven baseline days.
    """
    t = F.col("published_at")
    inside = within(t, now, window.seconds)
    rows = mentions.where(within(t, now, max(window.seconds, 7 * 86400)) & (t <= ts(now))).select(
        "trend_id", "published_at", "sentiment", "author_quality", "bot_score", inside.alias("inside"),
        bucket_index(t, now, window).alias("b"), F.floor(age_hours(t, now) / 24).alias("day"), age_hours(t, now).alias("age"),
    )
    b, inn = F.col("b"), F.col("inside")
    weight = F.coalesce("author_quality", F.lit(0.5)) * F.exp(-F.col("age") / 6.0)
    felt = inn & F.col("sentiment").isNotNull()
    hours = sorted(set(params.EVIDENCE_HOURS.values()))
    agg = rows.groupBy("trend_id").agg(
        F.count_if(inn).alias("mentions"),
        F.array(*[F.count_if(inn & (b == i)) for i in range(window.buckets)]).alias("counts"),
        F.array(*[F.count_if(F.col("day") == i) for i in range(1, 7)]).alias("per_day"),
        F.avg(F.when(inn, F.coalesce("bot_score", F.lit(0.0)))).alias("bot"),
        F.sum(F.when(felt, weight * F.col("sentiment"))).alias("_sn"), F.sum(F.when(felt, weight)).alias("_sd"),
        F.min(F.when(inn, F.col("published_at"))).alias("first_seen"),
        F.max(F.when(inn, F.col("published_at"))).alias("last_seen"),
        *[F.count_if(F.col("age") < h).alias(f"posts_{h}h") for h in hours],
    ).where("mentions > 0")
    days = F.array_sort("per_day")
    return agg.select(
        "*",
        (F.col("mentions") / F.lit(float(window.hours))).alias("v_raw"),
        ((F.get(days, 2) + F.get(days, 3)) / 2 / 24.0).alias("baseline"),
        F.coalesce(F.col("_sn") / F.nullif(F.col("_sd"), F.lit(0.0)), F.lit(0.0)).alias("sentiment"),
        ewma_series(F.col("counts"), window).alias("ewma"),
    ).drop("_sn", "_sd", "per_day")


def breadth(mentions: DataFrame, now: datetime, window: params.ScoreWindow) -> DataFrame:
    """Distinct authors, sources, communities and media urls inside the window."""
    media = F.col("source").isin(params.MEDIA)
    return in_window(mentions, now, window).groupBy("trend_id").agg(
        F.count_distinct("author_id").alias("unique_authors"),
        F.count_distinct("source").alias("unique_sources"),
        F.count_distinct(F.coalesce("community", "source")).alias("unique_communities"),
        F.count_distinct(F.when(media, F.col("url"))).alias("media_sources"))


def subscores(df: DataFrame, p95: Column, tracked: int = 9) -> DataFrame:
    """Seven parts in 0..1."""
    k = F.size("counts")
    x = F.aggregate(F.transform("counts", xlog2x), F.lit(0.0), lambda s, v: s + v)
    h = F.when(F.col("mentions") == 0, 1.0).otherwise(entropy(F.col("mentions"), x, k))
    return df.withColumns({
        "s_volume": clamp01(F.log10(1 + F.col("mentions")) / F.log10(F.lit(101.0))),
        "s_velocity": clamp01(F.col("v_ewma") / F.greatest(p95, F.lit(1e-6))),
        "s_breadth": clamp01(F.col("unique_authors") / 14.0),
        "s_crosssrc": clamp01(F.col("unique_sources") / F.lit(float(max(tracked, 3)))),
        "s_origin": clamp01(F.col("origin_quality")),
        "s_temporal": 1 - h,
        "s_baseline": clamp01(F.abs(F.col("delta")) / 500.0),
    })


def penalties(df: DataFrame) -> DataFrame:
    """Multiplicative penalties: few authors per mention, bots, recycled story."""
    r = F.col("unique_authors") / F.col("mentions")
    return df.withColumns({
        "p_spam": F.when(r < 0.4, r / 0.4).otherwise(1.0),
        "p_bot": 1 - clamp01(F.col("bot")),
        "p_recycle": F.when(F.col("recycled"), 0.3).otherwise(1.0),
    })


def confidence(df: DataFrame) -> DataFrame:
    base = sum((F.col(f"s_{k}") * w for k, w in params.CONFIDENCE_WEIGHTS.items()), F.lit(0.0))
    return df.withColumn("confidence", js_round(100 * clamp01(base) * F.col("p_spam") * F.col("p_bot") * F.col("p_recycle")))


def slopes(df: DataFrame, window: params.ScoreWindow, series: str = "ewma") -> DataFrame:
    """Quarter-window slopes, their difference, and variance over mean of the last six."""
    s, n = F.col(series), F.size(series)
    q = F.greatest(F.lit(1), F.floor(n / 4)).cast("int")
    at = lambda back: F.get(s, n - 1 - back)
    dt = window.hours / 4.0
    last6 = F.slice(s, F.greatest(F.lit(1), n - 5), 6)
    mean = F.aggregate(last6, F.lit(0.0), lambda a, x: a + x) / F.size(last6)
    enough = n >= 4
    short, long = (at(F.lit(0)) - at(q)) / dt, (at(q) - at(2 * q)) / dt
    return df.withColumns({
        "slope_short": F.when(enough, short).otherwise(0.0),
        "slope_long": F.when(enough, long).otherwise(0.0),
        "variance_ratio": F.when(enough & (mean > 0), variance_pop(last6) / mean).otherwise(0.0),
    }).withColumn("slope_accel", F.col("slope_short") - F.col("slope_long"))


def shape_and_direction(df: DataFrame) -> DataFrame:
    s = F.greatest(F.col("sigma"), F.lit(1e-6))
    short, accel = F.col("slope_short"), F.col("slope_accel")
    return df.withColumns({
        "shape": F.when((F.col("variance_ratio") > 1.5) & (F.abs(short) < 0.15 * s), "wobble")
        .when((accel > 0.3 * s) & (short > 0), "accel")
        .when((short > 0.2 * s) & (accel >= -0.1 * s), "rise")
        .when(short < -0.3 * s, "decay").otherwise("flat"),
        "dir": F.when(short > 0.05 * s, "up").when(short < -0.05 * s, "down").otherwise("flat"),
    })


def heat(df: DataFrame) -> DataFrame:
    soft = F.sqrt(F.col("p_spam") * F.col("p_bot"))
    score = clamp01(0.5 * F.col("s_velocity") + 0.3 * F.col("s_baseline") + 0.2 * F.col("s_origin")) * soft
    return df.withColumn("heat_score", score).withColumn("heat", heat_label(F.col("heat_score")))


def heat_label(x: Column) -> Column:
    return F.when(x >= 0.85, HEAT_HOT).when(x >= 0.60, HEAT_WARM).when(x >= 0.30, HEAT_MILD).otherwise(HEAT_COOL)


def status(shape: Column, h: Column, sources: Column, mentions: Column) -> Column:
    """First matching rule wins."""
    return (
        F.when((shape == "accel") & (h >= 0.6), "Crecimiento acelerado")
        .when(shape == "decay", "Interés en descenso")
        .when((shape == "wobble") & (h < 0.5), "Señal débil")
        .when((shape == "rise") & (h >= 0.45) & (sources == 1) & (mentions < 40), "Rumor en crecimiento")
        .when((shape == "rise") & (h >= 0.45), "Señal emergente")
        .when((shape == "accel") & (h < 0.45), "Señal emergente")
        .when((shape == "flat") & (h >= 0.3), "Actividad estable")
        .when(shape == "wobble", "Actividad inestable")
        .when(h < 0.3, "Señal débil")
        .otherwise("Actividad estable")
    )


def evidence(df: DataFrame) -> DataFrame:
    """Up to nine ranked candidates, the three best kept."""
    hours = F.lit(None).cast("bigint")
    label = F.lit(None).cast("string")
    for sh, h in params.EVIDENCE_HOURS.items():
        hours = F.when(F.col("shape") == sh, F.col(f"posts_{h}h")).otherwise(hours)
        label = F.when(F.col("shape") == sh, F.lit(f"Posts en {h}h")).otherwise(label)
    tenth = js_round(F.col("sentiment") * 10) / F.lit(10.0)
    signed = F.concat(F.when(tenth >= 0, "+").otherwise(""), F.format_string("%.1f", tenth))
    days = F.array(*[F.lit(d) for d in WEEKDAYS])
    clock = F.date_format("peak_at", "HH:mm")
    recent = F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(F.col("peak_at").cast("timestamp")) < 86_400_000_000
    peak = F.when(recent, clock).otherwise(F.concat_ws(" ", F.get(days, F.dayofweek("peak_at") - 1), clock))
    d = F.col("delta")

    def item(priority, name, value, when=None):
        s = F.struct(F.lit(-priority).alias("rank") if isinstance(priority, int) else (-priority).alias("rank"),
                     (F.lit(name) if isinstance(name, str) else name).alias("label"), value.cast("string").alias("value"))
        return s if when is None else F.when(when, s)

    wide = F.col("unique_communities")
    items = F.array(
        item(100, label, hours),
        item(90, "Comunidades", wide, wide >= 2),
        item(F.when(F.col("media_sources") == 0, 80).otherwise(60), "Medios", F.col("media_sources")),
        item(70, "Origen", F.col("originator"), F.col("originator").isNotNull()),
        item(75, "Sentimiento", signed, F.col("shape").isin("flat", "wobble")),
        item(85, "Pico", peak, (F.col("shape") == "decay") & F.col("peak_at").isNotNull()),
        item(50, "Hilos activos", F.least(wide, F.lit(12)), wide >= 3),
        item(65, "Δ vs 7d", F.concat(F.when(d >= 0, "+").otherwise(""), d.cast("string"), F.lit("%")), F.abs(d) >= 200),
        item(40, "Fuentes", F.col("unique_sources")),
    )
    best = F.slice(F.array_sort(F.array_compact(items)), 1, 3)
    return df.withColumn("evidence", F.transform(best, lambda s: F.struct(s["label"].alias("label"), s["value"].alias("value"))))


def why(df: DataFrame) -> DataFrame:
    d = F.col("delta")
    wide, media = F.col("unique_communities"), F.col("media_sources")
    return df.withColumn("why", F.concat(F.concat_ws(
        ", ",
        F.when(d >= 100, F.format_string("+%d%% en la última ventana", d)).when(d <= -20, F.format_string("%d%% (perdiendo tracción)", d)),
        F.format_string("%d menciones/h, %d autores únicos", F.col("velocity"), F.col("unique_authors")),
        F.when(wide >= 3, F.format_string("en %d comunidades", wide)),
        F.when(media == 0, "sin cobertura mediática aún").otherwise(F.format_string("%d medio(s) recogiendo", media)),
    ), F.lit(".")))


def global_p95(facts: DataFrame) -> Column:
    """95th percentile of the smoothed rate over all trends, as a scalar subquery."""
    return facts.agg(F.percentile(F.get("ewma", F.size("ewma") - 1), F.lit(0.95)).alias("p")).scalar()


def compute_score(
    mentions: DataFrame,
    now: datetime,
    window: params.ScoreWindow,
    recycled: DataFrame | None = None,
    sigma: DataFrame | None = None,
    tracked: int = 9,
) -> DataFrame:
    """Score every trend over ``window``.

    ``recycled``: trend ids seen in the last 30 days. ``sigma``: (trend_id, sigma)
    noise of the velocity; by default the deviation of the smoothed series.
    """
    facts = window_facts(mentions, now, window)
    df = facts.join(breadth(mentions, now, window), "trend_id").join(
        origin_quality_first5(in_window(mentions, now, window)), "trend_id")
    if recycled is None:
        df = df.withColumn("recycled", F.lit(False))
    else:
        df = df.join(recycled.select("trend_id", F.lit(True).alias("recycled")), "trend_id", "left").fillna({"recycled": False})
    df = df.join(sigma, "trend_id", "left") if sigma is not None else df.withColumn("sigma", F.sqrt(variance_pop(F.col("ewma"))))
    peak = F.array_position("counts", F.array_max("counts")) - 1
    df = df.withColumns({
        "v_ewma": F.get("ewma", F.size("ewma") - 1),
        "velocity": js_round(F.col("v_raw")),
        "delta": delta_pct(F.col("v_raw"), F.col("baseline"), F.col("mentions")),
        "peak_at": F.timestamp_micros(
            F.unix_micros(ts(now, -window.seconds).cast("timestamp")) + peak * F.lit(int(window.seconds / window.buckets * 1e6))
        ).cast("timestamp_ntz"),
    })
    df = confidence(penalties(subscores(df, global_p95(facts), tracked)))
    df = heat(shape_and_direction(slopes(df, window)))
    df = df.withColumn("status", status(F.col("shape"), F.col("heat_score"), F.col("unique_sources"), F.col("mentions")))
    return why(evidence(df))
