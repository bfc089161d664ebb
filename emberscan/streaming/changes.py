"""Change events of trends, in batch. The streaming twin is in ``stateful``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_events(metrics: DataFrame, spike_ratio: float = 2.0, t: str = "at") -> DataFrame:
    """Upsert, phase-change and velocity-spike events per metrics row."""
    w = Window.partitionBy("trend_id").orderBy(t)
    m = metrics.select("*", F.lag("phase").over(w).alias("prev_phase"), F.lag("velocity").over(w).alias("prev_velocity"))
    kinds = F.array_compact(F.array(
        F.lit("trend.upserted"), F.when(F.col("prev_phase") != F.col("phase"), "trend.phase_changed"),
        F.when(F.col("velocity") > spike_ratio * F.col("prev_velocity"), "trend.velocity_spike")))
    return m.select("trend_id", t, "phase", "velocity", F.explode(kinds).alias("type"))
