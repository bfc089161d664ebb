"""Metrics at a grid of historical clocks."""

from __future__ import annotations

import math
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.numeric import entropy, xlog2x
from ..functions.times import epoch_micros, micros, ts
from . import score_early as early
from .profile import lookup


def _history(decay: float, day: int):
    """All that a trend had before each tick: mentions, those older than a day, sums of decay and of trust."""
    def run(slots: pa.Table) -> pa.Table:
        step, edge, n, w, trust = (slots.column(c).to_numpy() for c in ("step", "edge", "n", "w", "trust"))
        order = np.argsort(-step, kind="stable")
        s, first = np.unique(-step[order], return_index=True)
        s, n_at, w_at, t_at = -s, *(np.add.reduceat(x[order], first) for x in (n, w, trust))
        fresh, past = np.empty(len(s)), 0.0
        for i in range(len(s)):
            past = w_at[i] + (past * decay ** int(s[i - 1] - s[i]) if i else 0.0)
            fresh[i] = past
        tick = np.unique((s[:, None] - np.arange(4)).ravel())
        tick = tick[tick >= 0]
        i = np.searchsorted(-s, -tick, side="right") - 1  # the slot that is last before the tick
        late = np.argsort(-(step - edge), kind="stable")  # a mention exactly a day before the tick is not older
        older = np.append(0, np.cumsum(n[late]))[np.searchsorted(-(step - edge)[late], -(tick + day), side="right")]
        return pa.table({
            "trend_id": pa.array([slots.column("trend_id")[0].as_py()] * len(tick), pa.string()), "tick": pa.array(tick, pa.int64()), "mentions": pa.array(np.cumsum(n_at)[i], pa.int64()),
            "older": pa.array(older, pa.int64()), "w": pa.array(fresh[i] * decay ** (s[i] - tick)), "t": pa.array(np.cumsum(t_at)[i])})
    return run


def tick_scores(mentions: DataFrame, now: datetime, step_seconds: float, trust: dict[str, float] = params.TRUST_STRICT) -> DataFrame:
    """The whole early score at every tick that has a mention in its long window: what ``early_score`` says of ``trend_profile`` at that clock.

    Tick 0 is ``now``, tick k is k steps, or short windows, earlier. A mention
    is counted into the at most four ticks whose long window holds it, so
    nothing is joined to the grid: rows are reduced to (trend, source, author,
    step), spread to four ticks, and reduced again over two grouping sets. What
    reaches back to the first mention is summed over a trend's steps, whose
    number the clock bounds.
    """
    width = int(step_seconds * 1e6)
    age = F.lit(epoch_micros(now)) - micros(F.col("published_at"))
    rate = math.log(2) / params.HALF_LIFE_HOURS / 4
    m = mentions.where(F.col("published_at") <= ts(now)).withColumns({"step": F.floor(age / F.lit(width)), "edge": (F.pmod(age, F.lit(width)) == 0).cast("long")})
    fine = m.groupBy("trend_id", "source", "author_id", "step", "edge").agg(
        F.count("*").alias("n"), F.sum("sentiment").alias("s"), F.sum(F.exp(-rate * (age / F.lit(width) - F.col("step")))).alias("w"), F.max(age).alias("age"))
    slots = fine.groupBy("trend_id", "step", "edge").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("n") * lookup(F.col("source"), trust, params.TRUST_DEFAULT)).alias("trust"))
    past = slots.groupBy("trend_id").applyInArrow(_history(math.exp(-rate), 96), "trend_id string, tick long, mentions long, older long, w double, t double")
    # A mention at the open end of the long window counts for the flooding author only.
    back = F.explode(F.sequence(F.lit(0), 3 + F.col("edge")))
    spread = fine.select("*", back.alias("back")).withColumn("tick", F.col("step") - F.col("back")).where("tick >= 0")
    till = lambda k, c="n": F.sum(F.when(F.col("back") <= k, F.col(c)).otherwise(0))
    part = spread.groupingSets([["trend_id", "tick", "author_id"], ["trend_id", "tick", "source"]], "trend_id", "tick", "author_id", "source").agg(
        F.grouping("source").alias("by_author"), till(0).alias("m15"), till(1).alias("m30"), till(3).alias("m60"), till(3, "s").alias("s60"), F.sum("n").alias("c60"))
    a, s = F.col("by_author") == 1, F.col("by_author") == 0
    of = lambda on, c: F.when(on, F.col(c))
    per = part.groupBy("trend_id", "tick").agg(
        *[F.sum(of(a, c)).alias(c) for c in ("m15", "m30", "m60")], (F.sum(of(a, "s60")) / F.sum(of(a, "m60"))).alias("sentiment"),
        F.max(of(a, "c60")).alias("max_author60"), F.count_if(a & (F.col("m60") > 0)).alias("authors60"),
        F.count_if(s & (F.col("m60") > 0)).alias("sources60"), F.count_if(s & (F.col("m15") > 0)).alias("sources15"), F.max(of(s, "m60")).alias("max_source60"),
        F.sum(F.when(s & F.col("source").isin(params.SOCIAL), F.col("m60"))).alias("social60"), F.sum(F.when(s, xlog2x(F.col("m15")))).alias("_x15")).where("m60 > 0")
    born = fine.groupBy("trend_id").agg(F.max("age").alias("_age"))
    rows = per.join(past, ["trend_id", "tick"]).join(born, "trend_id").withColumns({
        "entropy15": F.when(F.col("sources15") > 1, F.least(F.lit(1.0), entropy(F.col("m15"), F.col("_x15"), F.col("sources15")))).otherwise(F.lit(0.0)),
        "freshness": F.col("w") / F.col("mentions"), "trust": F.col("t") / F.col("mentions"), "age_hours": (F.col("_age") / F.lit(width) - F.col("tick")) / 4,
        "at": F.timestamp_micros(F.lit(epoch_micros(now)) - F.col("tick") * F.lit(width)).cast("timestamp_ntz")})
    return early.early_score(rows.drop("_x15", "_age", "w", "t"), early.STRICT)
