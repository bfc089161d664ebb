"""Faults of the fourth round's findings: small cases that failed before."""

import os

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connection


# ---- g21_legitimacy (F1), p20_role_presets (F2) ----------------------------------------
@pytest.mark.parametrize("name", ["g21_legitimacy", "p20_role_presets"])
def test_posts_without_author_or_trend_are_one_story_without_name(spark, sf, tmp_path, name):
    """A story is named by author and trend; without one of them it has no name, as in the SQL."""
    import __spark_entry__ as entry

    for t in os.listdir(sf):
        if t != "events.parquet":
            os.symlink(f"{sf}/{t}", tmp_path / t)
    events = spark.read.parquet(f"{sf}/events.parquet")
    i = F.col("event_id")
    events = events.withColumn("user_id", F.when(i % 7 > 0, F.col("user_id"))).withColumn("props", F.when(i % 13 > 0, F.col("props")))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = connection(sf)
    con.execute("SET threads=1")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert compare(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name]) == []


# ---- d8_keep_earliest (F6), d7_c2_near_duplicate_groups (F7) ---------------------------
def test_large_sets_that_cannot_match_are_no_pairs(spark, monkeypatch):
    """Sets around and beyond ``LONG`` of a small vocabulary: groups equal brute force, and whole sets travel for pairs near the threshold only."""
    import random

    from emberscan.operators import graph

    monkeypatch.setattr(graph, "LONG_BLOCK", 5, raising=False)
    asked, verified = [], graph._verified
    monkeypatch.setattr(graph, "_verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    rnd = random.Random(4)
    sets = [set(rnd.sample(range(5000), rnd.choice((60, 300, 900, 1100, 1300, 2000, 2500)))) for _ in range(70)]
    for i in range(0, 70, 3):
        old = sorted(sets[i])
        share = rnd.choice((0.05, 0.1, 0.14, 0.149, 0.151, 0.17))
        sets.append(set(old[int(share * len(old)):]))
        sets.append(set(old[:len(old) - len(old) // 20]) | {10_000 + i})
    sets += [sets[0], set()]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= 0.85 - 1e-12:
                near += 1
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    df = spark.createDataFrame([(i, [f"w{t}" for t in sorted(s)]) for i, s in enumerate(sets)], "id long, toks array<string>")
    got = {r.id: r.component for r in graph.near_duplicate_groups(df).collect()}
    assert got == {i: root(i) for i in range(len(sets))}
    assert near and sum(asked) <= 2 * near


# ---- d5_d6_j1_lsh_candidates (F5) ------------------------------------------------------
def test_candidate_pairs_are_never_shuffled(spark, monkeypatch, capsys):
    """No join or grouping sees a pair; over sides and chunks they equal brute force, with copies, large values and texts without tokens."""
    import random
    from collections import defaultdict

    from emberscan.operators import dedup

    monkeypatch.setattr(dedup, "SIDE_BYTES", 4 * 128 * 40, raising=False)
    monkeypatch.setattr(dedup, "PAIRS", 7, raising=False)
    rnd = random.Random(6)
    big = dedup.PRIME - 1
    pool = [[rnd.randrange(big) for _ in range(128)] for _ in range(12)]
    sigs = [[p if rnd.random() < 0.6 else rnd.choice((1, big, big - 2**32)) for p in rnd.choice(pool)] for _ in range(250)]
    sigs += [sigs[3], sigs[3], [-1] * 128, [-1] * 128]
    df = spark.createDataFrame(list(enumerate(sigs)), "doc_id long, sig array<bigint>")
    out = dedup.candidate_pairs(df, "doc_id")
    out.explain()
    assert "Join" not in capsys.readouterr().out
    held = defaultdict(list)
    for i, s in enumerate(sigs):
        held[tuple(s)].append(i)
    want = set()
    for s, a in held.items():
        for t, b in held.items():
            shared = sum(s[k:k + 4] == t[k:k + 4] for k in range(0, 128, 4))
            if a[0] < b[0] and shared:
                want.add((a[0], b[0], len(a), len(b), shared, sum(x == y for x, y in zip(s, t)) / 128))
    got = [tuple(r) for r in out.select("a", "b", "docs_a", "docs_b", "shared", "jaccard_est").collect()]
    assert set(got) == want and len(got) == len(want) > 1000


# ---- c7_fork_detection (F4) ------------------------------------------------------------
def test_communities_of_vectors_store_no_edges(spark, monkeypatch, tmp_path):
    """Dense clusters over several parts and runs of columns: the first level equals Louvain on the listed edges, which are never rows."""
    import numpy as np

    from emberscan.operators import graph, vectors

    monkeypatch.setattr(graph, "PART_ROWS", 40, raising=False)
    monkeypatch.setattr(graph, "COLUMNS", 7, raising=False)
    rnd = np.random.default_rng(3)
    heart = rnd.normal(size=(4, 16))
    rows = [(i, i % 2, (heart[i % 4 if i % 3 else (i + 2) % 4] + 0.7 * rnd.normal(size=16)).tolist()) for i in range(150)] + [(1000, 7, [1.0] + [0.0] * 15)]
    df = spark.createDataFrame(rows, "id long, cluster long, vec array<double>")
    n = vectors.nearest(df, df, None, 0.3, earlier_only=True, within="cluster", keep_within=True)
    edges = n.select(F.col("within").alias("cluster"), F.col("id").alias("src"), F.col("neighbour").alias("dst"), F.col("cosine").alias("w")).cache()
    assert edges.count() > 10 * len(rows)
    key = lambda f: sorted((r.id, r.cluster, r.label, r.modularity and round(r.modularity, 9), r.split, r.version) for r in f.collect())
    want = key(graph.forks(df.select("id", "cluster"), edges))
    held, keep = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda d: held.append(keep(d)) or held[-1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # a part and its columns come in many batches
    try:
        got = key(graph.forks_of_vectors(df, 0.3))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and max(d.count() for d in held) <= len(rows)
