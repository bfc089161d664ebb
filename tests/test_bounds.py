"""No operator stops or cuts at a size: many leaders in one bucket, many checks, long histories."""

import numpy as np
from pyspark.sql import functions as F

from emberscan.operators import clusters, graph, search, vectors


def _gate(pairs):
    return pairs.where("a_x = b_x").select("leader", "leader_ord", "id", F.lit(1.0).alias("score"))


def test_a_thousand_leaders_in_one_bucket(spark):
    items = spark.range(1000).select("id", F.col("id").alias("ord"), F.col("id").alias("last_ord"), F.col("id").alias("x"))
    chosen, matches = graph.leaders(items, items.select("id", F.lit(1).alias("bucket")), _gate)
    assert chosen.count() == 1000 and matches.count() == 0


def test_leaders_and_members_in_one_bucket(spark):
    items = spark.range(400).select("id", F.col("id").alias("ord"), F.col("id").alias("last_ord"), (F.col("id") % 90).alias("x"))
    chosen, matches = graph.leaders(items, items.select("id", F.lit(1).alias("bucket")), _gate, ahead=4)
    assert sorted(r.id for r in chosen.collect()) == list(range(90))
    assert {(r.leader, r.id) for r in matches.collect()} == {(i % 90, i) for i in range(90, 400)}


def test_no_items(spark):
    items = spark.range(0).select("id", F.col("id").alias("ord"), F.col("id").alias("last_ord"), F.col("id").alias("x"))
    chosen, matches = graph.leaders(items, items.select("id", F.lit(1).alias("bucket")), _gate)
    assert chosen.count() == matches.count() == 0


def test_merges_in_late_checks(spark):
    """Two clusters meet in the last two of a hundred checks only."""
    rows = []
    for no in range(100):
        near = no >= 98
        rows += [(no, 1, 10, [1.0, 0.0]), (no, 2, 5, [1.0, 0.1] if near else [0.0, 1.0]), (no, 3, 1, [-1.0, 0.0])]
    checks = spark.createDataFrame(rows, "check_no int, id long, born long, centroid array<double>")
    got = clusters.merge_pairs(checks).collect()
    assert [(r.a, r.b, r.check_no, r.survivor) for r in got] == [(1, 2, 99, 2)]


def test_drift_of_a_long_history(spark):
    for alpha, n in ((0.001, 900), (0.1, 600)):
        rows = [("k", i, [1.0 if i == 0 else 0.0, float(i % 7)]) for i in range(n)]
        got = vectors.drift(spark.createDataFrame(rows, "k string, o long, v array<double>"), "k", "o", "v", alpha).first()["centroid"]
        c = np.array(rows[0][2])
        for _, _, v in rows[1:]:
            c = alpha * np.array(v) + (1 - alpha) * c
        assert np.allclose(got, c, rtol=1e-9, atol=0)


def test_all_neighbours_inside_a_group(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i % 3, rng.normal(size=6).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, g int, vec array<double>")
    got = {(r.id, r.neighbour) for r in vectors.nearest(df, df, None, 0.3, earlier_only=True, cells=5, within="g").collect()}
    u = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    want = {(a, b) for a, ga, _ in rows for b, gb, _ in rows if b < a and ga == gb and u[a] @ u[b] >= 0.3}
    assert got == want


def test_forks(spark):
    """Two cliques joined by one edge are two communities; one clique is not split."""
    def clique(cluster, ids):
        return [(cluster, a, b, 1.0) for a in ids for b in ids if a < b]

    edges = clique(1, range(6)) + clique(1, range(10, 15)) + [(1, 0, 10, 0.1)] + clique(2, range(20, 26))
    nodes = [(i, 1) for i in (*range(6), *range(10, 15))] + [(i, 2) for i in range(20, 26)]
    f = graph.forks(spark.createDataFrame(nodes, "id long, cluster long"), spark.createDataFrame(edges, "cluster long, src long, dst long, w double"), 0.6).collect()
    by = {r.id: r for r in f}
    assert by[0].modularity > 0.4 and by[0].split and [by[i].version for i in (0, 5, 10, 14)] == [1, 1, 2, 2]
    assert abs(by[20].modularity) < 1e-9 and len({r.version for r in f if r.cluster == 2}) == 1


def test_equal_documents_rank_by_id(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma delta " * (1 + i % 2)) for i in range(12)], "id long, text string")
    q = spark.createDataFrame([(1, "gamma alpha beta")], "query_id long, q string")
    got = [r.id for r in search.bm25(q, docs, "id", "text", 12).orderBy("rank").collect()]
    even, odd = got[:6], got[6:]
    assert sorted(even) == even and sorted(odd) == odd and len({i % 2 for i in even}) == 1
