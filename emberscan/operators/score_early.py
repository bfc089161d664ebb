"""Early-detection score over ``trend_profile`` rows: expressions only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.numeric import js_round2

STRICT, RELAXED = "strict", "relaxed"


def with_motion(profile: DataFrame) -> DataFrame:
    """Velocity, acceleration and their ratio (per scaled minute).

    The ratio is NULL with ``is_new`` set when only the short window has posts.
    """
    v, v60 = F.col("m15") / 15.0, F.col("m60") / 60.0
    return profile.withColumns({"velocity": v, "velocity60": v60}).withColumns({
        "acceleration": F.col("velocity") - F.col("velocity60"),
        "is_new": (F.col("velocity60") == 0) & (F.col("velocity") > 0),
        "accel_ratio": F.when(F.col("velocity60") > 0, F.col("velocity") / F.col("velocity60"))
        .when(F.col("velocity") > 0, F.lit(None)).otherwise(F.lit(0.0)),
    })


def with_cold_start(df: DataFrame, tick_no: int, minutes_per_hour: float = 60.0) -> DataFrame:
    """Velocity estimate for the first three ticks, when no history exists yet."""
    estimate = F.col("mentions") / F.greatest(F.lit(5.0), F.col("age_hours") * minutes_per_hour)
    boost = (F.lit(tick_no) < 3) & (F.col("mentions") > 0) & (F.col("velocity") < estimate)
    return df.withColumns({
        "eff_velocity": F.when(boost, F.greatest(F.col("velocity"), estimate * 0.5)).otherwise(F.col("velocity")),
        "eff_is_new": F.when(boost, F.lit(False)).otherwise(F.col("is_new")),
        "eff_ratio": F.when(boost, F.lit(1.5)).otherwise(F.col("accel_ratio")),
    })


def acceleration_score(ratio: Column, is_new: Column) -> Column:
    return (
        F.when(is_new, 1.0).when(ratio >= 2, 1.0)
        .when(ratio >= 1, 0.5 + (ratio - 1) * 0.5)
        .when(ratio >= 0.5, 0.2 + (ratio - 0.5) * 0.6)
        .otherwise(F.greatest(F.lit(0.0), ratio * 0.4))
    )


def penalty_authors(df: DataFrame) -> DataFrame:
    """Additive penalty: flooding author, few authors per mention, old mentions."""
    spam = F.when(F.col("max_author60") > 14, 0.4).otherwise(0.0)
    bot = F.when(F.col("unique_authors") / F.col("mentions") < 0.4, 0.3).otherwise(0.0)
    old = F.when(F.col("older") / F.col("mentions") > 0.3, 0.3).otherwise(0.0)
    return df.withColumns({"p_spam": spam, "p_bot": bot, "p_recycle": old,
                           "penalty": F.least(F.lit(1.0), spam + bot + old)})


def penalty_dominance(df: DataFrame) -> DataFrame:
    """Additive penalty: flooding author, one author above half, old mentions."""
    spam = F.when(F.col("max_author60") > 14, 0.4).otherwise(0.0)
    share = F.col("max_author60") / F.greatest(F.lit(1), F.col("m60"))
    bot = F.when((F.col("m60") > 2) & (share > 0.5), 0.4).otherwise(0.0)
    old = F.when(F.col("older") / F.greatest(F.lit(1), F.col("mentions")) > 0.3, 0.3).otherwise(0.0)
    return df.withColumns({"p_spam": spam, "p_bot": bot, "p_recycle": old,
                           "penalty": F.least(F.lit(1.0), spam + bot + old)})


def with_raw_score(df: DataFrame, profile: str = STRICT) -> DataFrame:
    """Weighted sum of the seven parts times one minus the penalty, two decimals."""
    w = params.EARLY_WEIGHTS
    relaxed = profile == RELAXED
    velocity, is_new, ratio = (
        (F.col("eff_velocity"), F.col("eff_is_new"), F.col("eff_ratio")) if relaxed
        else (F.col("velocity"), F.col("is_new"), F.col("accel_ratio"))
    )
    entropy = F.col("entropy_all") if relaxed else F.col("entropy15")
    fresh = (
        F.least(F.lit(1.0), F.exp(-F.col("idle_hours") / params.HALF_LIFE_HOURS)) if relaxed
        else F.least(F.lit(1.0), F.col("freshness"))
    )
    authors = F.when(F.col("m60") > 0, F.least(F.lit(1.0), F.col("authors60") / F.col("m60"))).otherwise(
        F.when(F.col("m15") > 0, 0.5).otherwise(0.0)
    )
    total = (
        w["velocity"] * F.least(F.lit(1.0), velocity / 5)
        + w["acceleration"] * acceleration_score(ratio, is_new)
        + w["spread"] * F.least(F.lit(1.0), F.col("sources60") / 3)
        + w["entropy"] * entropy + w["authors"] * authors + w["freshness"] * fresh + w["trust"] * F.col("trust")
    )
    return df.withColumn("raw_score", js_round2(total * (1 - F.col("penalty")) * 100))


def with_gates(df: DataFrame, profile: str = STRICT, tick_no: int = 100) -> DataFrame:
    """Floors and corroboration gates. Their order is part of the result.

    The gates are a list folded over the raw score: where ``on`` holds and the
    running score is at least ``at``, it is limited to ``cap``. Folding names the
    running score once per gate, so a filter on the score that Catalyst pushes
    down does not multiply the expression.
    """
    m15, m30, m60, wide = F.col("m15"), F.col("m30"), F.col("m60"), F.col("sources60")
    if profile == STRICT:
        slow = ~F.col("is_new") & (F.col("accel_ratio") < 1.5)
        gates = [
            (m30 == 0, 0, 5), (m60 == 0, 0, 0), (F.col("mentions") == 1, 0, 15),
            ((m15 < 2) | (wide < 2), 50, 49), (slow | (wide < 3), 70, 69),
        ]
    else:
        gate = 25 if tick_no < 5 else 40
        slow = ~F.col("eff_is_new") & (F.col("eff_ratio") < 1.2)
        gates = [
            (m60 == 0, 0, 10), ((m30 == 0) & (m60 > 0), 0, 25), (F.col("mentions") == 1, 0, 20),
            (m60 < 2, gate, gate - 1), (slow | (wide < 2), 60, 59),
        ]
    steps = F.array(*[
        F.struct(F.coalesce(on, F.lit(False)).alias("on"), F.lit(float(at)).alias("at"), F.lit(float(cap)).alias("cap"))
        for on, at, cap in gates
    ])
    return df.withColumn("gated_score", F.aggregate(
        steps, F.col("raw_score"),
        lambda s, g: F.when(g["on"] & (s >= g["at"]), F.least(s, g["cap"])).otherwise(s)))


def with_quota(df: DataFrame, share_window: str = "60m") -> DataFrame:
    """Penalise one dominating source without social posts; decide trending."""
    top = F.col("max_source60") if share_window == "60m" else F.col("max_source")
    df = df.withColumns({
        "source_share": F.when(F.col("m60") > 0, top / F.col("m60")).otherwise(F.lit(0.0)),
        "has_social": F.coalesce(F.col("social60"), F.lit(0)) > 0,
    })
    share, social, s = F.col("source_share"), F.col("has_social"), F.col("gated_score")
    cut = F.least(F.lit(0.5), (share - 0.35) * 1.5)
    df = df.withColumn("score", js_round2(s * F.when((share > 0.35) & ~social, 1 - cut).otherwise(F.lit(1.0))))
    return df.withColumn(
        "is_trending",
        (F.col("score") >= 35) & (F.col("m60") >= 2) & (F.col("m30") >= 1) & (social | (share <= 0.5)),
    )


def shape(accel: Column, ratio: Column, is_new: Column, history: Column | None = None) -> Column:
    """Shape of the motion; ``history`` is an ARRAY of past short-window counts."""
    out = (
        F.when(is_new & (accel > 0), "accel")
        .when((ratio >= 2) & (accel > 0), "accel")
        .when((accel > 0.05) & (is_new | (ratio >= 1.2)), "rise")
        .when((accel < -0.05) | (~is_new & (ratio > 0) & (ratio < 0.5)), "decay")
    )
    if history is not None:
        # variance / (mean * mean + 1) > 0.5, on sums of whole counts, so that a tie is a tie
        n, total = F.size(history), F.aggregate(history, F.lit(0.0), lambda a, x: a + x)
        squares = F.aggregate(history, F.lit(0.0), lambda a, x: a + x * x)
        swings = 2 * (n * squares - total * total) > total * total + n * n
        out = out.when((n >= 5) & (F.abs(accel) < 0.05) & swings, "wobble")
    return out.otherwise("flat")


def phase(df_shape: Column, velocity: Column) -> Column:
    """Early phase from age, counts, acceleration and shape."""
    return (
        F.when((F.col("age_hours") < 2) & (F.col("m15") >= 2) & (F.col("acceleration") > 0) & (F.col("sources15") >= 2), "rising")
        .when((velocity > 0.3) & (F.col("m60") >= 5) & (df_shape != "decay"), "peaked")
        .when((df_shape == "decay") | (F.col("m15") == 0), "decaying")
        .otherwise("forming")
    )


def early_score(
    profile_rows: DataFrame,
    profile: str = STRICT,
    tick_no: int = 100,
    share_window: str = "60m",
    minutes_per_hour: float = 60.0,
    history: str | None = None,
) -> DataFrame:
    """Full early score: motion, penalty, score, gates, quota, shape, phase.

    ``strict`` decides the score from recent activity only; ``relaxed`` keeps
    idle trends visible and estimates velocity during the first ticks.
    """
    df = with_motion(profile_rows)
    if profile == RELAXED:
        df = with_cold_start(df, tick_no, minutes_per_hour)
    df = with_quota(with_gates(with_raw_score(penalty_dominance(df), profile), profile, tick_no), share_window)
    sh = shape(F.col("acceleration"), F.col("accel_ratio"), F.col("is_new"), F.col(history) if history else None)
    df = df.withColumn("shape", sh)
    velocity = F.col("eff_velocity") if profile == RELAXED else F.col("velocity")
    return df.withColumn("phase", phase(F.col("shape"), velocity))
