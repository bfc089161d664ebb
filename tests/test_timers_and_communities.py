"""Event-time timers with late rows and silence, Louvain communities, marks that run out: small cases against plain Python."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberscan.operators import dedup, graph, score_early, series
from emberscan.plans.streams import in_landings, to_table
from emberscan.streaming import ingest, timers

T0 = datetime(2024, 3, 1)


def posts(spark, rows):
    """(key, seconds after T0, source, landing) as posts with the order in which they land."""
    data = [(i, k, T0 + timedelta(seconds=s) if s is not None else None, src, land * 1000 + i % 7) for i, (k, s, src, land) in enumerate(rows)]
    df = spark.createDataFrame(data, "external_id long, trend_id string, published_at timestamp, source string, us long")
    return df.withColumn("author_id", F.lit(1))


def run(spark, df, transform):
    return in_landings(df, 3, "us", to_table(spark, transform)).collect()


def test_decay_of_silent_trends(spark):
    """A trend that stops, one that comes back, one with a null time, late rows inside the lateness, and ticks without rows."""
    rnd = random.Random(1)
    rows = [("a", rnd.randrange(0, 3600), rnd.choice("xy"), 0) for _ in range(40)]
    rows += [("b", 60 * i, "x", 0 if i < 100 else 1) for i in range(0, 300, 7)]
    rows += [("b", 60 * 95, "y", 1), ("a", None, "x", 0), (None, 5, "x", 0)]  # late, but not too late
    rows += [("a", 40_000 + i, "x", 1) for i in range(5)] + [("c", 90_000, "x", 2)]
    got = {(r.trend_id, r.at_us // 60_000_000): (r.m15, r.m30, r.m60, r.sources60) for r in run(spark, posts(spark, rows), timers.decaying_metrics)}
    base, want = int(T0.timestamp()) // 60, {}
    end = base + (90_000 - 3600) // 60
    for k in "ab":
        mine = [(base + s // 60, src) for t, s, src, _ in rows if t == k and s is not None]
        before = 0
        for t in range(base // 15 * 15, end + 1):
            if t % 15 or not t * 60 < base * 60 + 90_000 - 3600:
                continue
            m = [sum(t - w <= u < t for u, _ in mine) for w in (15, 30, 60)]
            if m[2] or before:
                want[k, t] = (*m, len({s for u, s in mine if t - 60 <= u < t}))
            before = m[2]
    assert got == want
    assert sum(v == (0, 0, 0, 0) for v in want.values()) >= 3


def test_life_cycle_of_clusters(spark):
    day = 86_400
    rows = [("a", 0, "x", 0), ("a", 10, "x", 0), ("a", day + 11, "x", 0), ("a", 9 * day, "x", 1), ("b", 5 * day, "x", 1), ("b", 5 * day - 1800, "x", 1), ("c", 20 * day, "x", 2)]
    rows += [("a", 16 * day, "x", 1), (None, 3, "x", 0), ("b", None, "x", 0)]
    got = sorted((r.key, r.at_us // 1_000_000 - int(T0.timestamp()), r.kind, r.version) for r in run(spark, posts(spark, rows), timers.life_cycle))
    assert got == [("a", 0, "new", 1), ("a", day + 10, "archived", 1), ("a", day + 11, "reopened", 1), ("a", 2 * day + 11, "archived", 1), ("a", 9 * day, "renewed", 2),
                   ("a", 10 * day, "archived", 2), ("a", 16 * day, "reopened", 2), ("a", 17 * day, "archived", 2), ("b", 5 * day - 1800, "new", 1), ("b", 6 * day, "archived", 1)]
    with pytest.raises(ValueError):
        timers.life_cycle(posts(spark, rows), archive_hours=0)


def test_pickup_of_late_answers(spark):
    rows = [("a", 0, "p", 0), ("a", 100, "q", 1), ("a", 50, "q", 1), ("a", 3600, "p", 0), ("a", 7201, "q", 1), ("b", 10, "p", 0), ("a", 10, None, 0), (None, 20, "p", 0), ("~", 10**6, "p", 2), ("~", 10**6, "q", 2)]
    got = {r.external_id: r.lag_us // 1_000_000 for r in run(spark, posts(spark, rows), lambda s: timers.pickup(s, "p", "q", lateness="6 hours"))}
    assert got == {0: 50}


def test_event_log_and_rate(spark):
    rows = [("a", i // 3, "x", i // 20) for i in range(60)]
    events = posts(spark, rows).select(F.col("published_at").alias("ts"), "external_id", F.col("source").alias("type"), "us")
    log = run(spark, events, timers.numbered_events)
    assert Counter(r.ts_ms for r in log) == Counter(int(T0.timestamp()) * 1000 + 1000 * (i // 3) for i in range(60))
    assert len({r.event_id for r in log}) == 60 and all(r.event_id == f"{r.ts_ms}-{r.seq}" for r in log) and {r.seq for r in log} == {1, 2, 3}
    rate = run(spark, events, lambda s: timers.event_rate(s, "10 seconds", lateness="0 seconds"))
    assert [(r.events, r.per_second) for r in rate] == [(30, 3.0)]


def modularity(edges, label):
    m2, deg, inner = 2 * sum(w for *_, w in edges), Counter(), Counter()
    for a, b, w in edges:
        deg[label[a]] += w
        deg[label[b]] += w
        inner[label[a]] += 2 * w if label[a] == label[b] else 0
    return sum(inner[c] / m2 - (deg[c] / m2) ** 2 for c in deg)


def test_louvain(spark):
    """Planted groups in one cluster, a path in another, a lone node; labels are the smallest ids and never cross clusters."""
    rnd = random.Random(3)
    planted = {i: i // 8 * 8 for i in range(32)}
    edges = [(0, a, b, 1.0) for a in planted for b in planted if a < b and (planted[a] == planted[b] and rnd.random() < 0.8)]
    edges += [(0, a, b, 0.2) for a, b in ((0, 8), (9, 17), (20, 28), (5, 30))]
    edges += [(1, 100 + i, 101 + i, 1.0) for i in range(9)]
    nodes = [(i, 0) for i in planted] + [(100 + i, 1) for i in range(10)] + [(500, 2)]
    n, e = spark.createDataFrame(nodes, "id long, cluster long"), spark.createDataFrame(edges, "cluster long, src long, dst long, w double")
    got = {r.id: (r.cluster, r.label) for r in graph.louvain(n, e).collect()}
    assert {i: got[i][1] for i in planted} == planted and got[500] == (2, 500)
    path = {i: got[i][1] for i in range(100, 110)}
    best = max(modularity([(a, b, w) for c, a, b, w in edges if c == 1], {100 + i: sum(i > x for x in cuts) for i in range(10)}) for cuts in ((), (4,), (2, 6), (2, 5), (3, 6), (1, 4, 6)))
    assert modularity([(a, b, w) for c, a, b, w in edges if c == 1], path) > 0.9 * best
    assert all(min(i for i in path if path[i] == c) == c for c in set(path.values()))


def test_marks_run_out(spark):
    rnd = random.Random(5)
    rows = [(f"k{i % 3}", rnd.randrange(0, 1000), i) for i in range(200)] + [("hot", i, 1000 + i) for i in range(0, 900, 2)] + [("hot", 100, 1), (None, 3, 2)]
    df = spark.createDataFrame([(k, T0 + timedelta(seconds=s), i) for k, s, i in rows], "key string, at timestamp, id long")
    want, per = set(), defaultdict(list)
    for k, s, i in rows:
        per[k].append((s, i))
    for k in per.keys() - {None}:
        last = None
        for s, i in sorted(per[k]):
            if last is None or s >= last + 100:
                last = s
                want.add((k, s, i))
    start = int(T0.timestamp())
    assert {(r.key, r.us // 1_000_000 - start, r.id) for r in dedup.first_within_ttl(df, ["key"], "at", "id", 100).collect()} == want


def test_history_and_wobble(spark):
    now = T0 + timedelta(hours=2)
    at = {"new": [1], "swing": [5, 5, 5, 95, 96, 97, 98], "old": [119] * 3}
    df = spark.createDataFrame([(k, now - timedelta(minutes=m)) for k, ms in at.items() for m in ms], "trend_id string, published_at timestamp_ntz")
    got = {r.trend_id: r.history for r in series.recent_counts(df, now, 600, 12).collect()}
    assert got == {"new": [1.0], "swing": [4.0] + [0.0] * 8 + [3.0], "old": [3.0] + [0.0] * 11}
    rows = spark.createDataFrame([("a", [4.0, 0.0, 0.0, 0.0, 3.0]), ("b", [2.0] * 5), ("c", [9.0, 0.0])], "k string, h array<double>")
    shapes = {r.k: r.s for r in rows.select("k", score_early.shape(F.lit(0.0), F.lit(1.0), F.lit(False), F.col("h")).alias("s")).collect()}
    assert shapes == {"a": "wobble", "b": "flat", "c": "flat"}


def test_failing_listener_stops_nothing(spark, tmp_path, capsys):
    """The ingest and the listeners after a failing one go on."""
    seen = []

    def broken(df, batch):
        raise RuntimeError("no")

    df = spark.createDataFrame([(1, "accepted"), (2, "future")], "external_id long, verdict string")
    ingest.split_batches(f"{tmp_path}/ok", f"{tmp_path}/bad", [broken, lambda d, b: seen.append((b, d.count()))])(df, 4)
    assert seen == [(4, 2)] and "broken" in capsys.readouterr().out
    assert [r.external_id for r in spark.read.parquet(f"{tmp_path}/ok/b4").collect()] == [1]


def test_life_cycle_state_follows_buckets():
    """Many clusters reach the state as buckets, and many at once settle as one at a time would."""
    rnd = random.Random(7)
    hour = timers.HOUR_US
    rows = [(f"k{rnd.randrange(300)}", rnd.randrange(0, 1200 * hour)) for _ in range(2000)]
    waiting = pd.DataFrame([(k, us // hour, us, us) for k, us in rows], columns=timers._Life.HOURS)
    life = pd.DataFrame({"key": pd.Series(dtype=object), "last_us": pd.Series(dtype="int64"), "version": pd.Series(dtype="int64"), "archived": pd.Series(dtype=bool)})
    got = []
    for now in (100 * hour // 1000, 100 * hour // 1000, 700 * hour // 1000, 1190 * hour // 1000):
        out, life, waiting = timers._settle(life, waiting, now, 24 * hour, 168 * hour)
        got += out.itertuples(index=False, name=None)
    want, end = [], 1190 * hour // 1000
    for k in {k for k, _ in rows}:
        last, version = None, 0
        for us in [*sorted(us for j, us in rows if j == k and us // 1000 < end), None]:
            if last is not None and (us is None or us - last > 24 * hour) and (last + 24 * hour) // 1000 < end:
                want.append((k, version, "archived", last + 24 * hour))
            if us is not None and (last is None or us - last > 24 * hour):
                kind = "new" if last is None else "renewed" if us - last > 168 * hour else "reopened"
                version += kind != "reopened"
                want.append((k, version, kind, us))
            last = us if us is not None else last
    assert sorted(got) == sorted(want)


def test_life_cycle_state_is_cut_into_buckets(spark, tmp_path):
    """2,000 clusters are at most three state rows a bucket (a life, hours, a time due) and their timers, not rows of their own."""
    df = posts(spark, [(f"k{i}", 60 * i, "x", 0) for i in range(2000)]).select("trend_id", "published_at")
    df.write.parquet(f"{tmp_path}/in")
    s = timers.life_cycle(ingest.landed_parquet(spark, f"{tmp_path}/in", df.schema), buckets=16)
    q = s.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) < 300
