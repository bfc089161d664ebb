"""Alert rules over tick metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

RULE_SCHEMA = ("rule_id string, trend_id string, condition string, threshold double, threshold_max double, phase string, "
               "cooldown_sec bigint, armed boolean, severity string, user_id bigint")


def condition(kind: Column) -> Column:
    """Whether a rule's condition holds on a metrics row; NULL metrics do not fire."""
    x, hi = F.col("threshold"), F.col("threshold_max")
    cases = [
        ("score_gt", F.col("score") > x), ("velocity_gt", F.col("velocity") > x), ("mentions_gt", F.col("m60") > x),
        ("mentions_lt", F.col("m60") < x), ("phase_is", F.col("rule_phase") == F.col("phase")),
        ("phase_change", F.col("prev_phase") != F.col("phase")), ("delta_pct_gt", F.col("delta_pct") > x),
        ("source_breakout", F.col("sources60") > F.col("prev_sources60")), ("between", F.col("score").between(x, hi)),
        ("source_count", F.col("sources60") >= x), ("sentiment", F.abs(F.col("sentiment") - F.col("prev_sentiment")) * 100 > x),
    ]
    out = F.lit(False)
    for name, holds in reversed(cases):
        out = F.when(kind == name, F.coalesce(holds, F.lit(False))).otherwise(out)
    return out


def with_previous(metrics: DataFrame, key: str = "trend_id", t: str = "at") -> DataFrame:
    """Metrics rows with the values of the tick before. One row per trend and tick."""
    w = Window.partitionBy(key).orderBy(t)
    prev = metrics.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in ("phase", "m60", "sources60", "sentiment")])
    p = F.col("prev_m60").cast("double")
    return prev.withColumn("delta_pct", 100 * (F.col("m60") - p) / F.nullif(p, F.lit(0.0)))


#: Blocks of the rule index at most: their bounds ride with every task as one row a condition.
MAX_BLOCKS = 4096


def _measures() -> Column:
    """(condition, value) of a metrics row for every condition that compares a value; NULL where it cannot fire."""
    yes = lambda holds: F.when(holds, 1.0)
    of = {
        "score_gt": F.col("score"), "velocity_gt": F.col("velocity"), "mentions_gt": F.col("m60"), "mentions_lt": -F.col("m60"), "delta_pct_gt": F.col("delta_pct"),
        "between": F.col("score"), "source_count": F.col("sources60"), "sentiment": F.abs(F.col("sentiment") - F.col("prev_sentiment")) * 100,
        "phase_change": yes(F.col("prev_phase") != F.col("phase")), "source_breakout": yes(F.col("sources60") > F.col("prev_sources60"))}
    return F.array(*[F.struct(F.lit(k).alias("condition"), v.cast("double").alias("value")) for k, v in of.items()])


def rule_index(rules: DataFrame, block: int = 1000) -> DataFrame:
    """Rules without a trend that compare a value, in blocks sorted by (condition, least value that may fire).

    Every rule becomes an interval ``lo`` to ``hi`` of values outside of which it
    cannot fire; NaN, which sorts last, is the open end. A block is one range
    partition of that order, written once so that its number stays.
    """
    x, hi, kind = F.col("threshold"), F.col("threshold_max"), F.col("condition")
    top = F.lit(float("nan"))
    flag = kind.isin("phase_change", "source_breakout")
    lo = F.when(flag, 1.0).when(kind == "mentions_lt", F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(-x)).otherwise(x)
    up = F.when(flag, 1.0).when(kind == "between", hi).otherwise(top)
    held = rules.where(F.col("trend_id").isNull() & (kind != "phase_is")).withColumns({"lo": lo, "hi": up}).where("lo is not null and hi is not null")
    blocks = min(MAX_BLOCKS, held.count() // block + 1)
    return cut(held.repartitionByRange(blocks, "condition", "lo", "rule_id").withColumn("block", F.spark_partition_id()))


def hits(rules: DataFrame, metrics: DataFrame, block: int = 1000) -> DataFrame:
    """Armed rules whose condition holds, before any cooldown.

    Rules of a trend are an equi-join, as are global rules on a phase. Other
    global rules stand in ``rule_index``: a row looks its values up among the
    bounds of the blocks and joins only blocks in which a rule may fire, so the
    work follows what fires and not rows times rules. No threshold, no hit.
    """
    rows = with_previous(metrics)
    armed = rules.where("armed").withColumnRenamed("phase", "rule_phase")
    own = armed.where("trend_id is not null").join(rows, "trend_id")
    every = armed.where("trend_id is null").drop("trend_id")
    phased = every.where("condition = 'phase_is'").join(rows, F.col("rule_phase") == F.col("phase"))
    index = rule_index(armed, block)
    bounds = index.groupBy("condition", "block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).groupBy("condition").agg(
        F.collect_list(F.struct("block", "lo", "hi")).alias("bounds"))  # at most MAX_BLOCKS and one for each condition
    asked = rows.withColumn("_m", F.explode(_measures())).where("_m.value is not null")
    met = asked.join(F.broadcast(bounds.withColumnRenamed("condition", "_kind")), F.col("_m.condition") == F.col("_kind"))
    v = F.col("_m.value")
    routed = met.withColumn("block", F.explode(F.transform(F.filter("bounds", lambda b: (b["lo"] <= v) & (v <= b["hi"])), lambda b: b["block"])))
    ranged = routed.drop("bounds", "_m").join(index.drop("trend_id", "lo", "hi"), (F.col("condition") == F.col("_kind")) & (index["block"] == routed["block"]))
    found = own.unionByName(phased.select(own.columns)).unionByName(ranged.select(own.columns))
    return found.where(condition(F.col("condition")))


def _fires(hits: pa.Table) -> pa.Table:
    """Firings of one rule and trend: from each, on to the first hit that its cooldown has passed."""
    t = np.sort(hits.column("us").to_numpy())
    gap, at, out = hits.column("cooldown_sec")[0].as_py() * 1_000_000, 0, []
    while at < len(t):
        out.append(t[at])
        at = max(at + 1, int(np.searchsorted(t, t[at] + gap)))
    one = hits.slice(0, 1).select(["rule_id", "trend_id", "severity", "user_id"])
    rows = one.take(pa.array(np.zeros(len(out), np.int64)))
    return rows.append_column("fire_no", pa.array(np.arange(1, len(out) + 1), pa.int32())).append_column("us", pa.array(out, pa.int64()))


def fire(hit_rows: DataFrame) -> DataFrame:
    """Hits that fire: the first, then the first after each cooldown.

    One (rule, trend) is one group: its hits are at most one for each tick, whatever the traffic.
    """
    us = F.unix_micros(F.col("at").cast("timestamp"))
    rows = hit_rows.select("rule_id", "trend_id", "cooldown_sec", "severity", "user_id", us.alias("us"))
    fired = rows.groupBy("rule_id", "trend_id", "cooldown_sec", "severity", "user_id").applyInArrow(
        _fires, "rule_id string, trend_id string, severity string, user_id bigint, fire_no int, us bigint")
    return fired.select("rule_id", "trend_id", "severity", "user_id", "fire_no", F.timestamp_micros("us").cast("timestamp_ntz").alias("fired_at"))


def _spans(quiet: int):
    """Marks alerts sent and numbers the spans they open; of each (user, group) only the last sent time is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, span = None, None, 0
        for b in batches:
            sent, spans = [], []
            for user, group, us, change in zip(*(b.column(c).to_pylist() for c in ("user_id", "group_id", "us", "is_phase_change"))):
                if (user, group) != key:
                    key, last, span = (user, group), None, 0
                go = bool(change) or last is None or us - last >= quiet
                if go:
                    last, span = us, span + 1
                sent.append(go)
                spans.append(span)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent, pa.bool_()), pa.array(spans, pa.int64())], names=[*b.schema.names, "sent", "span"])
    return run


def limit_fatigue(fired: DataFrame, per_day: dict[str, int], groups: DataFrame, quiet_seconds: int = 7200) -> DataFrame:
    """Keep what a reader should get: one alert per group and quiet span, few per day.

    ``groups``: (trend_id, group_id) of similar trends. Within a user's group an
    alert is sent if none was sent in the ``quiet_seconds`` before it, or if it
    reports a phase change; ``stands_for`` counts it and those held back until
    the next one. Then the daily limit per user and severity applies. Rows stay
    rows: a group is read in order and never held as a whole.
    """
    quiet = quiet_seconds * 1_000_000
    keyed = fired.join(groups, "trend_id", "left").withColumn("group_id", F.coalesce("group_id", "trend_id"))
    us = F.unix_micros(F.col("fired_at").cast("timestamp"))
    rows = keyed.select("user_id", "group_id", "rule_id", "trend_id", "fired_at", "severity", "is_phase_change", us.alias("us"))
    inner = rows.repartition("user_id", "group_id").sortWithinPartitions("user_id", "group_id", "us", "rule_id", "trend_id", "fired_at", "severity", "is_phase_change")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    numbered = inner.mapInArrow(_spans(quiet), schema + ", sent boolean, span long")
    one = numbered.withColumn("stands_for", F.count("*").over(Window.partitionBy("user_id", "group_id", "span"))).where("sent").drop("sent", "span", "us")
    w = Window.partitionBy("user_id", "severity", F.to_date("fired_at")).orderBy("fired_at", "rule_id", "trend_id")
    limits = F.create_map(*[F.lit(v) for kv in per_day.items() for v in kv])
    out = one.withColumn("nth", F.row_number().over(w))
    return out.where(F.col("nth") <= F.coalesce(F.element_at(limits, F.col("severity")), F.lit(2_147_483_647)))


def severity(watched: Column, to_rising: Column, legit: Column, trash: Column, sources: Column, origin: Column, loud: Column) -> Column:
    """Severity of a trend event; first matching rule wins."""
    return (
        F.when(watched & to_rising & (legit == "LEGIT") & (trash < 0.3), "critical")
        .when(~watched & (sources >= 2) & (origin > 0.7) & (trash < 0.3), "high")
        .when(legit == "PRE_BURST", "medium").when((trash > 0.5) & loud, "warning").otherwise("info"))


def watch_alerts(quotes: DataFrame, watch: DataFrame) -> DataFrame:
    """Price targets, stops and label changes of watched items, one row per alert."""
    j = quotes.join(watch, "ticker")
    pct = lambda to: F.round((to - F.col("price")) / F.nullif(F.col("price"), F.lit(0.0)) * 100, 2)
    kinds = F.array_compact(F.array(
        F.when(F.col("target").isNotNull() & (F.col("price") >= F.col("target")), "target_hit"),
        F.when(F.col("stop").isNotNull() & (F.col("price") <= F.col("stop")), "stop_hit"),
        F.when(F.col("last_label").isNotNull() & (F.col("label") != F.col("last_label")), "signal_change")))
    return j.select("ticker", "price", pct(F.col("target")).alias("to_target_pct"), pct(F.col("stop")).alias("to_stop_pct"), F.explode(kinds).alias("alert"))
