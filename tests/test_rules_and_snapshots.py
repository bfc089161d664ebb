"""Rule index against every rule on every row; snapshot deltas against a dictionary."""

import random
import re
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberscan.operators import alerts, clusters, joins
from emberscan.sources.sinks import Snapshot
from emberscan.streaming.clustering import LeaderStore

KINDS = ["score_gt", "velocity_gt", "mentions_gt", "mentions_lt", "phase_is", "phase_change", "delta_pct_gt", "source_breakout", "between", "source_count", "sentiment", "unknown"]
METRICS = "trend_id string, at timestamp, score double, velocity double, m60 long, sources60 long, sentiment double, phase string"


def metrics(spark, n, seed=0):
    rnd = random.Random(seed)
    cell = lambda v: None if rnd.random() < 0.05 else v
    rows = [(f"t{i % 7}", datetime(2024, 1, 1) + timedelta(hours=i // 7), cell(float(rnd.randrange(100))), cell(rnd.random() * 5), cell(rnd.randrange(200)),
             cell(rnd.randrange(6)), cell(rnd.uniform(-1, 1)), cell(rnd.choice("abc"))) for i in range(n)]
    return spark.createDataFrame(rows, METRICS)


def rules(spark, n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x = rnd.choice([None, float(rnd.randrange(100)), float(rnd.randrange(6)), float("nan")] if i % 11 == 0 else [float(rnd.randrange(100)), float(rnd.randrange(6))])
        rows.append((f"r{i}", rnd.choice([None, None, None, f"t{i % 9}"]), rnd.choice(KINDS), x, rnd.choice([None, 60.0, 99.0]), rnd.choice("abc"), 60, rnd.random() < 0.9, "info", i % 3))
    return spark.createDataFrame(rows, alerts.RULE_SCHEMA)


@pytest.mark.parametrize("block", [3, 1000])
def test_hits_are_those_of_all_rules_on_all_rows(spark, block):
    r, m = rules(spark, 200), metrics(spark, 140)
    every = joins.rules_for_trends(r.where("armed"), alerts.with_previous(m), block).where(alerts.condition(F.col("condition")))
    key = ["rule_id", "trend_id", "at"]
    want, got = sorted(every.select(key).collect()), sorted(alerts.hits(r, m, block).select(key).collect())
    assert got == want and len(want) == len(set(want)) > 1000
    assert alerts.hits(r, m).columns == every.columns


def test_each_global_rule_meets_each_trend_once(spark):
    trends = spark.range(20).select(F.concat(F.lit("t"), "id").alias("trend_id"))
    r = rules(spark, 90)
    got = joins.rules_for_trends(r, trends, 7).select("rule_id", "trend_id").collect()
    want = {(x.rule_id, f"t{i}") for x in r.collect() for i in range(20) if x.trend_id in (None, f"t{i}")}
    assert len(got) == len(want) and set(got) == want


def test_a_hundred_thousand_rules_without_a_nested_loop(spark):
    r = spark.range(100_000).select(
        F.concat(F.lit("r"), "id").alias("rule_id"), F.lit(None).cast("string").alias("trend_id"), F.lit("score_gt").alias("condition"), (F.col("id") / 1000.0).alias("threshold"),
        F.lit(None).cast("double").alias("threshold_max"), F.lit(None).cast("string").alias("phase"), F.lit(60).cast("long").alias("cooldown_sec"), F.lit(True).alias("armed"),
        F.lit("info").alias("severity"), F.lit(1).cast("long").alias("user_id"))
    m = metrics(spark, 35)
    h = alerts.hits(r, m)
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert h.count() == sum(sum(1 for _ in range(int(x.score * 1000))) for x in m.collect() if x.score is not None)


def test_no_rules_and_no_rows(spark):
    assert alerts.hits(rules(spark, 0), metrics(spark, 14)).count() == alerts.hits(rules(spark, 20), metrics(spark, 0)).count() == 0


def snapshot(spark, **more):
    return Snapshot(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/s", "k", "v", **more)


def test_batches_retries_ties_and_compaction(spark):
    rnd, snap, want = random.Random(5), snapshot(spark, rows_per_bucket=40), {}
    for no in range(6):
        rows = [(rnd.choice([None, *range(150)]), rnd.randrange(4), f"{no}.{i}") for i in range(60)]
        df = spark.createDataFrame(rows, "k long, v int, text string")
        for _ in range(2):  # every batch is repeated
            snap.upsert(df, no)
        best = {}
        for k, v, t in rows:
            best[k] = max(best.get(k, (v, t)), (v, t))
        for k, (v, t) in best.items():
            if k not in want or v >= want[k][0]:
                want[k] = (v, t)
        if no in (1, 3):
            snap.compact()
            snap.compact()
            snap.clear()
            snap.upsert(df, no)  # the base has it
        assert {r.k: (r.v, r.text) for r in snap.read().collect()} == want
    some = spark.createDataFrame([(3,), (3,), (77,), (9999,)], "k long")
    assert {r.k: (r.v, r.text) for r in snap.lookup(some).collect()} == {k: want[k] for k in (3, 77) if k in want}
    assert snap.due()


def test_a_small_batch_writes_its_own_rows(spark):
    snap = snapshot(spark)
    snap.upsert(spark.range(10_000).select(F.col("id").alias("k"), F.lit(1).alias("v")), 0)
    snap.compact()
    snap.upsert(spark.range(0, 10_000, 100).select(F.col("id").alias("k"), F.lit(2).alias("v")), 1)
    assert spark.read.parquet(f"{snap.path}/delta/b1-1").count() == 100 and not snap.due()
    assert snap.read().where("v = 2").count() == 100 and snap.read().count() == 10_000
    with pytest.raises(ValueError):
        snapshot(spark).read()


def test_empty_batches(spark):
    snap = snapshot(spark, rows_per_bucket=10)
    none = spark.createDataFrame([], "k long, v int")
    snap.upsert(none, 0)
    snap.compact()
    assert snap.lookup(spark.range(3).select(F.col("id").alias("k"))) is None
    snap.upsert(spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("v")), 1)
    snap.compact()
    snap.upsert(none, 2)
    assert snap.read().count() == 50 and snap.lookup(spark.range(3).select(F.col("id").alias("k"))).count() == 3
    assert snap.lookup(none, before=2).count() == 0


def test_rows_by_another_column_than_the_key(spark):
    snap = snapshot(spark, rows_per_bucket=20, by="g")
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), F.lit(0).alias("v"), (F.col("id") % 10).alias("g"))
    snap.upsert(rows(0, 100), 0)
    snap.compact()
    snap.upsert(rows(100, 150), 1)
    one = spark.createDataFrame([(3,)], "g long")
    assert {r.k for r in snap.lookup(one).collect()} == {k for k in range(150) if k % 10 == 3}
    assert {r.k for r in snap.lookup(one, before=1).collect()} == {k for k in range(100) if k % 10 == 3}
    plan = snap.lookup(one)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket", plan)


def test_landings_with_a_repeat_equal_the_batch(spark):
    """The band index is compacted on the way; the third batch runs twice."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    seeds, texts = [[word() for _ in range(30)] for _ in range(9)], []
    for i in range(30):
        t = list(rnd.choice(seeds))
        if i % 3:
            t[rnd.randrange(30)] = word()
        texts.append((i, " ".join(t)))
    docs = spark.createDataFrame(texts, "id long, text string")
    store = LeaderStore(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/s", rows_per_bucket=50)
    for b in range(4):
        part = docs.where((F.col("id") >= 8 * b) & (F.col("id") < 8 * b + 8))
        for _ in range(2 if b == 2 else 1):
            store.assign(part, b)
    got = {r.id: r.leader for r in store.assignments().collect()}
    want = {r.id: r.leader for r in clusters.leader_clusters(docs).collect()}
    assert got == want and len(want) == 30 > len(set(want.values()))
    base, deltas = store.bands._state()
    assert base and base[1] > 1 and len(deltas) < 4
