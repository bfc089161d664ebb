"""Operators that act when time passes, not only when rows arrive: event-time timers driven by the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TICK_SCHEMA = "trend_id string, at_us bigint, m15 bigint, m30 bigint, m60 bigint, sources60 int, velocity double, acceleration double"
LIFE_SCHEMA = "key string, version bigint, kind string, at_us bigint"
HOUR_US = 3_600_000_000


def _slots(width_us: int, extra: list[str]):
    """First, last and number of rows per (key, slot of time, extra columns) of each Arrow batch, before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["us"].notna()]
            if len(pdf):
                pdf = pdf.assign(slot=pdf["us"] // width_us)
                out = pdf.groupby(["key", "slot", *extra], as_index=False, dropna=False).agg(first_us=("us", "min"), last_us=("us", "max"), n=("us", "size"))
                yield out.assign(last_at=pd.to_datetime(out["last_us"], unit="us", utc=True))
    return run


def slots(mentions: DataFrame, key: str, width_us: int, lateness: str, *extra: str) -> DataFrame:
    """Rows combined per task to (key, slot, ...), under a watermark ``lateness`` behind the latest post.

    A busy key reaches its state as one row per slot and task. A slot counts as
    late when its last post is.
    """
    us = F.unix_micros(F.col("published_at").cast("timestamp"))
    rows = mentions.select(F.col(key).cast("string").alias("key"), us.alias("us"), *extra)
    schema = "key string, slot bigint, " + "".join(f"{c} string, " for c in extra) + "first_us bigint, last_us bigint, n bigint, last_at timestamp"
    return rows.mapInPandas(_slots(width_us, list(extra)), schema).withWatermark("last_at", lateness)


class _Ticks(StatefulProcessor):
    """Counts per (minute, source) of the long window of a trend, and the next tick to report.

    The state holds the minutes of one long window and of the lateness, however
    busy the trend is. Ticks are reported once the watermark has passed them, so
    every tick sees all its posts; a silent trend is reported until its long
    window is empty, last with zeros, and then sleeps until its next post.
    """

    def __init__(self, minute_us: int, every: int):
        self.minute_us, self.every = minute_us, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "minute bigint, source string", "n bigint")
        self.due = handle.getValueState("due", "minute bigint")

    def _next(self, minute: int) -> int:
        """First tick, in minutes, after a post of this minute."""
        return (minute // self.every + 1) * self.every

    def _wake(self, tick: int) -> None:
        self.due.update((tick,))
        self.handle.registerTimer(tick * self.minute_us // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            for minute, source, n in pdf[["slot", "source", "n"]].itertuples(index=False):
                k = (int(minute), source)
                old = self.counts.getValue(k)[0] if self.counts.containsKey(k) else 0
                self.counts.updateValue(k, (old + int(n),))
                first = k[0] if first is None else min(first, k[0])
        tick = self._next(first)
        if not self.due.exists() or tick < self.due.get()[0]:
            self._wake(tick)
        yield pd.DataFrame(columns=["trend_id", "at_us", "m15", "m30", "m60", "sources60", "velocity", "acceleration"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        out = []
        if self.due.exists():
            held = [(m, s, n) for (m, s), (n,) in self.counts.iterator()]
            minute, source, n = (np.array(c) for c in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64))
            tick = self.due.get()[0]
            while tick is not None and tick * self.minute_us // 1000 < now_ms:
                age = tick - minute
                m = [int(n[(age > 0) & (age <= w)].sum()) for w in (15, 30, 60)]
                out.append((key[0], tick * self.minute_us, *m, len(set(source[(age > 0) & (age <= 60)])), m[0] / 15.0, m[0] / 15.0 - m[2] / 60.0))
                ahead = minute[minute >= tick]
                tick = tick + self.every if m[2] else self._next(int(ahead.min())) if len(ahead) else None
            for m, s, _ in held:
                if tick is None or m < tick - 60:
                    self.counts.removeKey((m, s))
            if tick is None:
                self.due.clear()
            else:
                self._wake(tick)
        yield pd.DataFrame(out, columns=["trend_id", "at_us", "m15", "m30", "m60", "sources60", "velocity", "acceleration"])

    def close(self) -> None:
        pass


def decaying_metrics(mentions: DataFrame, minute_seconds: float = 60.0, every_minutes: int = 15, lateness: str = "1 hour") -> DataFrame:
    """Metrics of every trend at each tick of event time, also while it is silent; append mode.

    A tick is every ``every_minutes`` minutes since the epoch. m15, m30 and m60
    count the posts of the 15, 30 and 60 whole minutes before it. Rows without
    time or trend are left out.
    """
    minute_us = int(minute_seconds * 1e6)
    s = slots(mentions.where("trend_id is not null"), "trend_id", minute_us, lateness, "source")
    return s.groupBy("key").transformWithStateInPandas(_Ticks(minute_us, every_minutes), outputStructType=TICK_SCHEMA, outputMode="Append", timeMode="EventTime")


def _settle(life: pd.DataFrame, waiting: pd.DataFrame, now_ms: int, archive_us: int, renew_us: int) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """Transitions of many clusters up to a watermark, their lives after it, and the hours that still wait."""
    hours = waiting.groupby(["key", "slot"], as_index=False, sort=False).agg(first_us=("first_us", "min"), last_us=("last_us", "max"))
    ripe = hours["first_us"] // 1000 < now_ms
    rows, hours = hours[ripe].sort_values(["key", "first_us"]), hours[~ripe]
    none = np.iinfo(np.int64).min
    rows = rows.merge(life, on="key", how="left", suffixes=("", "_known"))
    known, at = rows["last_us_known"].fillna(none).astype(np.int64), rows.groupby("key", sort=False)
    ends = np.maximum(at["last_us"].cummax(), known)
    head = at.cumcount() == 0
    last = ends.shift(1, fill_value=none).where(~head, known)
    new, first = last == none, rows["first_us"]
    gap = (first - last.where(~new, first)).to_numpy()
    was = head & rows["archived"].eq(True)
    closes = ~new & ~was & (gap > archive_us)
    opens = new | was | closes
    kind = np.where(new, "new", np.where(gap > renew_us, "renewed", "reopened"))
    bump = (opens & (kind != "reopened")).astype(np.int64)
    version = rows["version"].fillna(0).astype(np.int64) + bump.groupby(rows["key"], sort=False).cumsum()
    out = [pd.DataFrame({"key": rows["key"], "version": version - bump, "kind": "archived", "at_us": last + archive_us})[closes],
           pd.DataFrame({"key": rows["key"], "version": version, "kind": kind, "at_us": first})[opens]]
    moved = pd.DataFrame({"key": rows["key"], "last_us": ends, "version": version, "archived": False}).drop_duplicates("key", keep="last")
    life = pd.concat([life[~life["key"].isin(moved["key"])], moved], ignore_index=True).astype({"last_us": np.int64, "version": np.int64, "archived": bool})
    idle = ~life["archived"] & ((life["last_us"] + archive_us) // 1000 < now_ms)
    out.append(pd.DataFrame({"key": life["key"], "version": life["version"], "kind": "archived", "at_us": life["last_us"] + archive_us})[idle])
    return pd.concat(out, ignore_index=True), life.assign(archived=life["archived"] | idle), hours


class _Life(StatefulProcessor):
    """Lives of the clusters of one bucket: last post, version, whether archived, and the hours that wait for the watermark.

    An hour is settled once the watermark has passed its first post: nothing
    can come before it any more. Gaps inside an hour never matter, so first and
    last post of an hour are all that is held. State is read and written a
    bucket at a time: a call for every cluster and hour costs far more than the
    work itself.
    """

    LIFE = ["key", "last_us", "version", "archived"]
    HOURS = ["key", "slot", "first_us", "last_us"]

    def __init__(self, archive_us: int, renew_us: int):
        self.archive_us, self.renew_us = archive_us, renew_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "key array<string>, last_us array<bigint>, version array<bigint>, archived array<boolean>")
        self.hours = handle.getListState("hours", "key array<string>, slot array<bigint>, first_us array<bigint>, last_us array<bigint>")
        self.due = handle.getValueState("due", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            self.hours.appendValue(tuple(pdf[c].tolist() for c in self.HOURS))
            low = int(pdf["first_us"].min()) // 1000
            first = low if first is None else min(first, low)
        if not self.due.exists() or first < self.due.get()[0]:
            self.due.update((first,))
            self.handle.registerTimer(first)
        yield pd.DataFrame(columns=["key", "version", "kind", "at_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        out = pd.DataFrame(columns=["key", "version", "kind", "at_us"])
        if self.due.exists() and self.due.get()[0] >= now_ms:
            if expiredTimerInfo.getExpiryTimeInMs() == self.due.get()[0]:
                self.handle.registerTimer(self.due.get()[0] + 1)  # fired at the watermark itself, which has not passed it
        elif self.due.exists():
            life = pd.DataFrame(dict(zip(self.LIFE, self.life.get() if self.life.exists() else ([], [], [], []))))
            chunks = [pd.DataFrame(dict(zip(self.HOURS, c))) for c in self.hours.get()]
            waiting = pd.concat(chunks, ignore_index=True) if chunks else pd.DataFrame({c: [] for c in self.HOURS})
            kinds = {"key": object, "slot": np.int64, "first_us": np.int64, "last_us": np.int64}
            life = life.astype({"key": object, "last_us": np.int64, "version": np.int64, "archived": bool})
            out, life, left = _settle(life, waiting.astype(kinds), now_ms, self.archive_us, self.renew_us)
            self.hours.clear()
            if len(left):
                self.hours.appendValue(tuple(left[c].tolist() for c in self.HOURS))
            self.life.update(tuple(life[c].tolist() for c in self.LIFE))
            open_ = life.loc[~life["archived"], "last_us"]
            due = [int(x.min()) // 1000 for x in (left["first_us"], open_ + self.archive_us) if len(x)]
            if due:
                self.due.update((min(due),))
                self.handle.registerTimer(min(due))
            else:
                self.due.clear()
        yield out

    def close(self) -> None:
        pass


def life_cycle(mentions: DataFrame, key: str = "trend_id", archive_hours: int = 24, renew_hours: int = 168, lateness: str = "1 hour", buckets: int = 512) -> DataFrame:
    """Transitions of every cluster as the watermark passes them: new, archived, reopened or renewed; append mode.

    Archived ``archive_hours`` after the last post; a later post reopens it, or,
    after ``renew_hours`` without one, renews it under the next version. Rows
    (key, version, kind, at_us). Rows without time or key are left out. The
    state is cut into ``buckets`` by hash of the key, each read and written whole.
    """
    if archive_hours < 1:
        raise ValueError("posts of one hour are held together, so a cluster is archived after an hour at least")
    s = slots(mentions.where(F.col(key).isNotNull()), key, HOUR_US, lateness)
    return s.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(
        _Life(archive_hours * HOUR_US, renew_hours * HOUR_US), outputStructType=LIFE_SCHEMA, outputMode="Append", timeMode="EventTime")


class _Answers(StatefulProcessor):
    """Posts of one trend whose interval begins in one slot of time, and the answers that can fall into it.

    Nothing is paired before the watermark has passed the last interval of the
    slot; then one sort finds the earliest answer of every post.
    """

    def __init__(self, span_us: int):
        self.span_us = span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.posts = handle.getListState("posts", "external_id array<bigint>, us array<bigint>")
        self.answers = handle.getListState("answers", "us array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            asked = pdf[pdf["asks"]]
            if len(asked):
                self.posts.appendValue((asked["external_id"].tolist(), asked["us"].tolist()))
            if len(asked) < len(pdf):
                self.answers.appendValue((np.unique(pdf.loc[~pdf["asks"], "us"].to_numpy(np.int64)).tolist(),))
        self.handle.registerTimer((int(key[1]) + 2) * self.span_us // 1000)
        yield pd.DataFrame(columns=["trend_id", "external_id", "lag_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        posts, answers = list(self.posts.get()), list(self.answers.get())
        self.posts.clear()
        self.answers.clear()
        out = pd.DataFrame(columns=["trend_id", "external_id", "lag_us"])
        if posts and answers:
            ids, us = (np.concatenate([np.asarray(p[i], dtype=np.int64) for p in posts]) for i in (0, 1))
            times = np.unique(np.concatenate([np.asarray(a[0], dtype=np.int64) for a in answers]))
            at = np.searchsorted(times, us)
            lag = np.where(at < len(times), times[np.minimum(at, len(times) - 1)] - us, self.span_us + 1)
            best = pd.DataFrame({"external_id": ids, "lag_us": lag})[lag <= self.span_us].groupby("external_id", as_index=False).min()
            out = best.assign(trend_id=key[0])[["trend_id", "external_id", "lag_us"]]
        yield out

    def close(self) -> None:
        pass


def pickup(mentions: DataFrame, first: str, then: str, within_seconds: int = 3600, lateness: str = "1 hour") -> DataFrame:
    """Each post of ``first`` with the lag to its earliest answer by ``then`` on its trend within the interval; append mode.

    A busy trend has very many pairs within an interval, so none are listed:
    time is cut into slots as long as the interval, a post belongs to its own
    slot and an answer to its own and the one before. A slot is held until the
    watermark has passed its last interval, and then given out and forgotten.
    Rows without time, trend or source are left out; so are rows that come after
    the watermark.
    """
    span_us = int(within_seconds) * 1_000_000
    t = F.col("published_at").cast("timestamp")
    us = F.unix_micros(t)
    rows = mentions.where("trend_id is not null and published_at is not null").where(F.col("source").isin(first, then))
    slot = F.floor(us / F.lit(span_us))
    asks, answers = F.col("source") == first, F.col("source") == then
    part = F.array_compact(F.array(F.when(asks, F.struct(slot.alias("slot"), F.lit(True).alias("asks"))), *[
        F.when(answers, F.struct((slot - i).alias("slot"), F.lit(False).alias("asks"))) for i in (0, 1)]))
    dealt = rows.select("trend_id", F.col("external_id").cast("bigint").alias("external_id"), t.alias("at"), us.alias("us"), F.explode(part).alias("p")).withWatermark("at", lateness)
    return dealt.select("trend_id", "external_id", "at", "us", F.col("p.slot").alias("slot"), F.col("p.asks").alias("asks")).groupBy("trend_id", "slot").transformWithStateInPandas(
        _Answers(span_us), outputStructType="trend_id string, external_id bigint, lag_us bigint", outputMode="Append", timeMode="EventTime")


class _Numbers(StatefulProcessor):
    """How many events of a millisecond have been numbered; forgotten once the watermark has passed it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        new = pd.concat(list(rows)).sort_values(["external_id", "type"])  # events of one millisecond within one trigger
        seq = np.arange(n + 1, n + len(new) + 1)
        self.count.update((n + len(new),))
        self.handle.registerTimer(int(key[0]))
        yield pd.DataFrame({"ts_ms": int(key[0]), "seq": seq, "event_id": [f"{key[0]}-{i}" for i in seq], "external_id": new["external_id"].to_numpy(), "type": new["type"].to_numpy()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.count.clear()
        yield pd.DataFrame(columns=["ts_ms", "seq", "event_id", "external_id", "type"])

    def close(self) -> None:
        pass


def numbered_events(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Event log entries with their id ``ms-seq``, numbered as they arrive; append mode.

    ``events``: (ts, external_id, type). Within a trigger the events of a
    millisecond are numbered by external_id and type. A number is never given
    twice for a millisecond that the watermark has not passed; later events of
    one that it has passed are late and left out.
    """
    timed = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.withColumn("ts_ms", F.unix_millis("ts")).groupBy("ts_ms").transformWithStateInPandas(
        _Numbers(), outputStructType="ts_ms bigint, seq bigint, event_id string, external_id bigint, type string", outputMode="Append", timeMode="EventTime")


def event_rate(events: DataFrame, width: str = "1 second", step: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Heartbeat counters: events of every window that had any, and per second; append mode."""
    timed = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    w = F.window("ts", width, step or width)
    per = timed.groupBy(w).agg(F.count("*").alias("events"))
    seconds = (F.unix_micros("window.end") - F.unix_micros("window.start")) / F.lit(1e6)
    return per.select(F.unix_millis("window.start").alias("start_ms"), F.unix_millis("window.end").alias("end_ms"), "events", (F.col("events") / seconds).alias("per_second"))
