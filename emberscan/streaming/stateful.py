"""Custom stateful operators: alerts with cooldown, change events, live metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ALERT_SCHEMA = "rule_id string, trend_id string, fire_no int, at_us bigint"
CHANGE_SCHEMA = "trend_id string, at_us bigint, type string"
METRIC_SCHEMA = "trend_id string, at_us bigint, m15 bigint, m30 bigint, m60 bigint, sources60 int, velocity double, acceleration double"


class _Alerts(StatefulProcessor):
    """Last firing and number of firings per (rule, trend)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at_us bigint, n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.last.get() if self.last.exists() else None
        last, n = (state[0], state[1]) if state is not None else (None, 0)
        hits = pd.concat(list(rows))  # hits of one rule and trend within one trigger
        out = []
        for at, cooldown in hits.sort_values("at_us")[["at_us", "cooldown_sec"]].itertuples(index=False):
            if last is None or at - last >= cooldown * 1_000_000:
                last, n = int(at), n + 1
                out.append((key[0], key[1], n, last))
        if out:
            self.last.update((last, n))
        yield pd.DataFrame(out, columns=["rule_id", "trend_id", "fire_no", "at_us"])

    def close(self) -> None:
        pass


def fire_alerts(hits: DataFrame) -> DataFrame:
    """Streaming cooldown over hits (rule_id, trend_id, cooldown_sec, at_us)."""
    return hits.groupBy("rule_id", "trend_id").transformWithStateInPandas(
        _Alerts(), outputStructType=ALERT_SCHEMA, outputMode="Append", timeMode="None")


class _Changes(StatefulProcessor):
    """Last phase and velocity per trend."""

    def __init__(self, spike_ratio: float):
        self.spike_ratio = spike_ratio

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prev = handle.getValueState("prev", "phase string, velocity double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.prev.get() if self.prev.exists() else None
        phase, velocity = (state[0], state[1]) if state is not None else (None, None)
        out = []
        ticks = pd.concat(list(rows)).sort_values("at_us")  # one row per tick of one trend
        for at, ph, v in ticks[["at_us", "phase", "velocity"]].itertuples(index=False):
            out.append((key[0], int(at), "trend.upserted"))
            if phase is not None and ph != phase:
                out.append((key[0], int(at), "trend.phase_changed"))
            if velocity is not None and v > self.spike_ratio * velocity:
                out.append((key[0], int(at), "trend.velocity_spike"))
            phase, velocity = ph, float(v)
        self.prev.update((phase, velocity))
        yield pd.DataFrame(out, columns=["trend_id", "at_us", "type"])

    def close(self) -> None:
        pass


def change_events(metrics: DataFrame, spike_ratio: float = 2.0) -> DataFrame:
    """Streaming change events from metrics rows (trend_id, at_us, phase, velocity)."""
    return metrics.groupBy("trend_id").transformWithStateInPandas(
        _Changes(spike_ratio), outputStructType=CHANGE_SCHEMA, outputMode="Append", timeMode="None")


class _LiveMetrics(StatefulProcessor):
    """Counts per (minute, source) of the long window of one trend.

    The state holds at most ``60 * sources`` entries however busy the trend is. A
    timer reports trends without new posts, so their velocity decays.
    """

    def __init__(self, minute_us: int, clock_us: int | None, every_ms: int):
        self.minute_us, self.clock_us, self.every_ms = minute_us, clock_us, every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "minute bigint, source string", "n bigint")

    def _report(self, trend: str, now_us: int) -> pd.DataFrame:
        """Row at ``now``. A minute counts when it began inside the window."""
        m = {15: 0, 30: 0, 60: 0}
        sources, dead = set(), []
        for (minute, source), (n,) in self.counts.iterator():
            age = (now_us - minute * self.minute_us) / self.minute_us
            if age >= 60:
                dead.append((minute, source))
                continue
            for w in m:
                m[w] += n if 0 <= age < w else 0
            sources.add(source)
        for k in dead:
            self.counts.removeKey(k)
        v15, v60 = m[15] / 15.0, m[60] / 60.0
        return pd.DataFrame([(trend, now_us, m[15], m[30], m[60], len(sources), v15, v15 - v60)],
                            columns=["trend_id", "at_us", "m15", "m30", "m60", "sources60", "velocity", "acceleration"])

    def _now(self, timerValues) -> int:
        return self.clock_us if self.clock_us is not None else timerValues.getCurrentProcessingTimeInMs() * 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for minute, source, n in pdf[["minute", "source", "n"]].itertuples(index=False):
                k = (int(minute), source)
                old = self.counts.getValue(k)[0] if self.counts.containsKey(k) else 0
                self.counts.updateValue(k, (old + int(n),))
        now_us = self._now(timerValues)
        if self.clock_us is None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(now_us // 1000 + self.every_ms)
        yield self._report(key[0], now_us)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_us = self._now(timerValues)
        row = self._report(key[0], now_us)
        if int(row["m60"].iloc[0]) > 0:
            self.handle.registerTimer(now_us // 1000 + self.every_ms)
        yield row

    def close(self) -> None:
        pass


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts per (trend, minute, source) of each Arrow batch, before the shuffle."""
    for pdf in batches:
        if len(pdf):
            yield pdf.groupby(["trend_id", "minute", "source"], as_index=False).size().rename(columns={"size": "n"})


def live_metrics(mentions: DataFrame, minute_seconds: float = 60.0, clock_us: int | None = None, every_ms: int = 45_000) -> DataFrame:
    """Velocity of every trend after each trigger, and again while it is quiet.

    Rows are combined to minute counts inside each task first, so a hot trend
    reaches its state as a few rows per task. ``clock_us`` fixes the clock.
    """
    from pyspark.sql import functions as F

    minute_us = int(minute_seconds * 1e6)
    us = F.unix_micros(F.col("published_at").cast("timestamp"))
    slots = mentions.select("trend_id", F.floor(us / F.lit(minute_us)).alias("minute"), "source")
    pre = slots.mapInPandas(_combine, "trend_id string, minute bigint, source string, n bigint")
    return pre.groupBy("trend_id").transformWithStateInPandas(
        _LiveMetrics(minute_us, clock_us, every_ms), outputStructType=METRIC_SCHEMA, outputMode="Update",
        timeMode="None" if clock_us is not None else "ProcessingTime")
